"""Benchmark decontamination as a prefix-filtered set join.

Windows of WINDOW item words are sought in documents.  A window's words are ordered by how many documents hold them; since
all of them must occur, the rarest alone is the necessary prefix.  A document is probed only where it holds such a word:
the word's place in the window fixes where the window would start and end (the positional and length bounds), and
only then is the whole window compared, by hash and then byte by byte.

Items are taken in blocks of at most BLOCK_WINDOWS windows, so what is sent to the tasks is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window; windows sent to the tasks at once.
WINDOW, BLOCK_WINDOWS = 10, 200_000


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts, ends and items' first words within them."""
    low = common.LOWER[data]
    return (low, *common.word_spans(low, at, common.NOT_ALNUM))


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item").to_pylist()
            for first, _, data, at in common.blocks(batch.column("text")):
                low, starts, ends, firsts = split_words(data, at)
                words = [low[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                rows = []
                for k in range(len(at) - 1):
                    own = words[firsts[k] : firsts[k + 1]]
                    rows += [(items[first + k], b" ".join(own[s : s + size])) for s in range(max(1, len(own) - size + 1)) if own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.binary())], names=["item", "words"])
    return run


class Index:
    """One block's windows, reached by their rarest words."""

    def __init__(self, rows: list[tuple[bytes, list[str]]], counts: dict[int, int] | None = None) -> None:
        self.texts, self.items = [w for w, _ in rows], [i for _, i in rows]
        joined = pa.array([w.decode() for w in self.texts], pa.large_string())
        data, at = common.buffers(joined)
        low, starts, ends, firsts = split_words(data, at)
        words = common.word_hashes(low, starts, ends)
        self.vocabulary = np.unique(words)
        prefix = common.prefix_hash(words)
        length = np.diff(firsts)
        whole = common.span_hash(prefix, firsts[:-1], firsts[1:])
        rare = np.zeros(len(rows), np.int64)
        if counts is not None:
            for k in range(len(rows)):
                own = words[firsts[k] : firsts[k + 1]].tolist()
                rare[k] = min(range(len(own)), key=lambda j: (counts.get(own[j], 0), own[j], j))
        token = words[firsts[:-1] + rare] if len(rows) else words
        order = np.argsort(token, kind="stable")
        self.window, self.offset, self.length, self.whole = order, rare[order], length[order], whole[order]
        self.tokens, self.first = np.unique(token[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def probe(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The occurrences of windows: document, first word, last word + 1, window."""
        if not len(starts) or not len(self.tokens):
            return []
        hashes = common.word_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        found = np.flatnonzero(self.tokens[at] == hashes)
        if not len(found):
            return []
        prefix, out = common.prefix_hash(hashes), []
        counts = (self.last - self.first)[at[found]]
        for part in np.array_split(np.arange(len(found)), max(1, int(counts.sum()) >> 20)):
            n = counts[part]
            place = np.repeat(found[part], n)
            entry = np.repeat(self.first[at[found[part]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = place - self.offset[entry]
            end = start + self.length[entry]
            doc = np.searchsorted(firsts, place, "right") - 1
            fits = (start >= firsts[doc]) & (end <= firsts[doc + 1])
            start, end, doc, entry = start[fits], end[fits], doc[fits], entry[fits]
            same = common.span_hash(prefix, start, end) == self.whole[entry]
            for d, s, e, w in zip(doc[same].tolist(), start[same].tolist(), end[same].tolist(), self.window[entry[same]].tolist(), strict=True):
                if b" ".join([low[a:z].tobytes() for a, z in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)]) == self.texts[w]:
                    out.append((d, s - int(firsts[d]), e - int(firsts[d]), w))
        return out


def _rarity(shared):
    """Of the block's words, how many documents hold each; reduced within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, data, at in common.blocks(batch.column("text")):
                low, starts, ends, firsts = split_words(data, at)
                hashes = common.word_hashes(low, starts, ends)
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[k] == hashes)
                doc = np.searchsorted(firsts, hit, "right") - 1
                total += np.bincount(np.unique(doc * len(known) + k[hit]) % len(known), minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["word", "n"])
    return run


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that the given ones cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _probe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            runs, items = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
            for first, last, data, at in common.blocks(batch.column("text")):
                low, starts, ends, firsts = split_words(data, at)
                n_words[first:last] = np.diff(firsts)
                hits: dict[int, list] = {}
                for d, s, e, w in index.probe(low, starts, ends, firsts):
                    hits.setdefault(first + d, []).append((s, e, w))
                for d, found in hits.items():
                    runs[d] = [{"a": a, "z": z} for a, z in merged([(x["a"], x["z"]) for x in runs[d]] + [(s, e) for s, e, _ in found])]
                    items[d] = sorted({*items[d], *(i for w in {w for _, _, w in found} for i in index.items[w])})
            arrays = [*(batch.column(c) for c in ("k", "text")), pa.array(n_words), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "text", "n_words", "runs", "items"])
    return run


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: key, text, n_words, runs (array of word ranges a to z that windows cover), items (sorted ids).

    A word is a run of digits, letters of a-z (A-Z count as them) and non-ASCII characters.  Items of fewer than ``window`` words are one
    window; items without words match nothing, null texts have no words, and null item ids stand as ''.  Equal items all
    count.  With an empty benchmark nothing is hit; other columns are ignored.
    """
    spark = common.prepare(docs.sparkSession)
    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    windows = common.cut(source.mapInArrow(_windows(window), "item string, words binary").distinct())
    blocks = max(1, -(-windows.count() // block))
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = plain.select("k", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<a:bigint,z:bigint>>)").alias("runs"), F.expr("cast(array() as array<string>)").alias("items"))
    for n in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == n).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
        rows = sorted((bytes(r.words), list(r.items)) for r in part.toLocalIterator())
        vocabulary = Index(rows).vocabulary
        counts: dict[int, int] = {}
        if len(vocabulary):
            found = plain.select("text").mapInArrow(_rarity(spark.sparkContext.broadcast(vocabulary)), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
            counts = {int(vocabulary[r.word]): r.n for r in found.collect()}
        shared = spark.sparkContext.broadcast(Index(rows, counts))
        out = out.mapInArrow(_probe(shared), f"k {kind}, text string, n_words long, runs array<struct<a:bigint,z:bigint>>, items array<string>")
        if n < blocks - 1:
            out = common.cut(out)
    return out.withColumnRenamed("k", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["z"] - r["a"])
    return find_contamination(docs, benchmark, key).select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
