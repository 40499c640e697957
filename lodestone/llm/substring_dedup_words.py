"""Substring deduplication of word windows over a log-structured fingerprint index.

The index holds sorted, immutable runs of fingerprints of historical windows: an anchor's hash, its context's hash, and the
first place of that context (see ``repeats``).  A batch of new documents is merge-joined with each run, which is bucketed and
sorted by the anchor, so only the batch moves to it; the fingerprints that meet are then dealt out with the batch's own.  Windows
that fingerprints call repeats are verified on the words of both texts; then the batch's own fingerprints become a new
run, and runs are compacted into one when there are too many.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

#: Words of a window, and the way repeated ones are narrowed down.
LENGTH = 50
UNITS = repeats.Units(length=LENGTH, gram=25, words=True, strict=True, hot=8_000)
#: Batches that a whole table is taken in, and runs that the index keeps before it compacts them.
BATCHES, MAX_RUNS = 3, 1


def later_windows(parts: list[bytes], d: np.ndarray, a: np.ndarray, group: np.ndarray | None = None, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (in words) of the fragments' windows that a document with a smaller key holds too, verified on the words."""
    text = b"\n".join(parts) + b"\n"
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    data = np.frombuffer(text, np.uint8)
    starts, ends, first = common.word_spans(data, begin)
    prefix = common.prefix_hash(common.word_hashes(data, starts, ends))
    runs = np.maximum(np.diff(first) - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(parts)), runs)
    at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    if not len(at):
        return d[:0], a[:0], a[:0]
    h = common.span_hash(prefix, at, at + LENGTH)
    later, source = _after_first(h, d[which])
    chosen = np.flatnonzero(later)
    if not len(chosen):
        return d[:0], a[:0], a[:0]
    mine, theirs = at[chosen], at[source[chosen]]
    follows = np.zeros(len(chosen), bool)
    follows[1:] = (np.diff(chosen) == 1) & (np.diff(mine) == 1) & (np.diff(theirs) == 1) & (np.diff(which[source[chosen]]) == 0) & (np.diff(which[chosen]) == 0)
    heads = np.flatnonzero(~follows)
    tails = np.append(heads[1:], len(chosen)) - 1
    for x, y in zip(heads.tolist(), tails.tolist(), strict=True):
        if text[starts[mine[x]] : ends[mine[y] + LENGTH - 1]] != text[starts[theirs[x]] : ends[theirs[y] + LENGTH - 1]]:
            exact: dict[bytes, int] = {}  # two windows share a hash: the words themselves are numbered
            number = [exact.setdefault(text[starts[i] : ends[i + LENGTH - 1]], len(exact)) for i in at.tolist()]
            later, _ = _after_first(np.array(number, np.uint64), d[which])
            chosen = np.flatnonzero(later)
            break
    return repeats.merged_spans(d[which[chosen]], (a[which] + at - first[which])[chosen], LENGTH)


def _after_first(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window whether an equal one is in a document with a smaller key, and the first such window."""
    order = np.lexsort((d, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    later, source = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    later[order] = d[order] > d[head]
    source[order] = head
    return later, source


class FingerprintIndex:
    """Sorted immutable runs of the window fingerprints of all documents added so far."""

    def __init__(self, spark: SparkSession, units: repeats.Units = UNITS, max_runs: int = MAX_RUNS) -> None:
        self.spark, self.units, self.max_runs = common.prepare(spark), units, max_runs
        self.runs: list[str] = []
        self.collided: DataFrame | None = None  # anchors that a run cannot tell apart
        self.folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        """A new run: the first place of each anchor and context, bucketed and sorted by anchor."""
        name = f"lodestone_run_{uuid.uuid4().hex}"
        firsts = rows.groupBy("h", "c").agg(F.min(F.struct("d", "q")).alias("at")).select("h", "c", "at.d", "at.q")
        dealt = firsts.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h", "c")
        dealt.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Spans (d, a, z) of words of ``batch`` (d, text) in windows that also start in a document with a smaller key.

        ``history`` (d, text) has the documents of the runs and of the batch; a batch's keys are greater than all before.
        """
        own = common.table(repeats.anchors(batch, self.units))
        rows = own.withColumn("old", F.lit(False))
        for run in self.runs:
            met = self.spark.table(run).join(own.select("h").distinct(), "h", "left_semi")
            rows = rows.unionByName(met.withColumn("more", F.lit(0).cast("long")).withColumn("old", F.lit(True)))
        marked = common.table(repeats.mark(rows, self.units))
        spans, self.collided = repeats.settled(history, marked, self.units, later_windows, self.collided)
        self.runs.append(self._write(own.where("h IS NOT NULL")))
        if len(self.runs) > self.max_runs:
            self.compact()
        return spans

    def compact(self) -> None:
        """All runs become one; a context keeps its first place."""
        old, rows = self.runs, self.spark.table(self.runs[0])
        for run in old[1:]:
            rows = rows.unionByName(self.spark.table(run))
        self.runs = [self._write(rows)]
        for run in old:
            self._drop(run)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        common.remove(self.spark, f"{self.folder}/{run}")

    def close(self) -> None:
        """Lets go of all runs and their files."""
        for run in self.runs:
            self._drop(run)
        self.runs = []


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copy, spans in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if copy and len(words) >= LENGTH:
                gone[0] = 1
            for s in spans if not copy else ():
                if s["z"] <= len(words):
                    gone[s["a"]] += 1
                    gone[s["z"]] -= 1
            kept = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g] if gone.any() else words
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, digest = zip(*rows, strict=True) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["k", "n_words", "n_removed", "kept_sha256"])


def window_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256.

    Each word covered by a window of LENGTH words that also starts in a document with a smaller key goes.  Documents go
    through a FingerprintIndex in ``batches`` ranges of their keys.  Words are what white space separates, unchanged; null texts
    have none, and texts of fewer than LENGTH words are left alone.  Null keys sort first; equal rows with one key are judged as
    one, and different texts with one key as documents in the order of their SHA-256.  Other columns are ignored, an empty
    table gives an empty result.
    """
    spark = common.prepare(docs.sparkSession)
    source, plain, _ = common.keyed(docs, key, text)
    copies = repeats.copies_of(plain)
    heads = plain.join(common.maybe_broadcast(copies), "d", "left_anti")
    cuts = plain.select(F.percentile_approx("d", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    index, found = FingerprintIndex(spark), []
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(edges, edges[1:], strict=False):
        history = heads if high is None else heads.where(F.col("d") <= high)
        batch = history if low is None else history.where(F.col("d") > low)
        spans = index.add(batch, history)
        found.append(spans if low is None else spans.where(F.col("d") > low))
    index.close()
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionAll(more)
    schema = f"k {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return repeats.apply_spans(source, copies, spans, _finish, schema).withColumnRenamed("k", key)
