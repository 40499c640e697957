"""Suffix-array deduplication of byte strings of documents.

Repeated strings are narrowed down by anchors (see ``repeats``).  The contexts left are concatenated, and their suffixes
sorted in two stages: suffixes smaller than their successors are sorted directly, the rest is induced by scanning the buckets of
first bytes in order, each scan vectorised.  Adjacent common prefixes then show equal strings, of which only the first one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

#: Bytes of a repeated string, and the way it is narrowed down.
LENGTH = 100
UNITS = repeats.Units(length=LENGTH, gram=32, words=False, strict=False, hot=24_000)

U64 = np.uint64
#: UTF-8 never holds the byte 0xC0, so those below it move up by one, in their order, and 0 is left for the separator.
_SHIFTED = bytes(b + (b < 0xC0) for b in range(256))


def word_keys(text: np.ndarray) -> np.ndarray:
    """For each position its next eight bytes, big-endian, zeros beyond the end."""
    key = np.pad(text, (0, 16)).astype(U64)
    n = len(text)
    two = (key[:-1] << U64(8)) | key[1:]
    four = (two[:-2] << U64(16)) | two[2:]
    eight = (four[:-4] << U64(32)) | four[4:]
    return eight[: n + 8]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the last one, before the empty suffix, is not."""
    n = len(text)
    differs = np.ones(n, bool)
    rises = np.zeros(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    rises[:-1] = text[:-1] < text[1:]
    at = np.where(differs, np.arange(n), n)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def sort_directly(suffixes: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes by their first ``depth`` bytes at least: eight bytes a round, of ties alone."""
    top = len(keys) - 1
    first = keys[np.minimum(suffixes, top)]
    order = np.argsort(first, kind="stable")
    out = suffixes[order]
    first = first[order]
    tied = np.zeros(len(out), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same])) if len(out) else np.zeros(0, int)
    for at in range(8, depth, 8):
        where = np.flatnonzero(tied)
        if not len(where):
            break
        own, of = out[where], group[where]
        key = keys[np.minimum(own + at, top)]
        order = np.lexsort((key, of))
        own, of, key = own[order], of[order], key[order]
        out[where] = own
        new = np.ones(len(where), bool)
        new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        group[where] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))] + len(out)
        still = np.zeros(len(where), bool)
        still[1:] |= ~new[1:]
        still[:-1] |= ~new[1:]
        tied[where] = still
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` in the order of their first ``depth`` bytes at least (where they reach so far).

    Zero bytes separate what was concatenated, so suffixes that start with one are not told apart; texts must hold none.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    rising = smaller_than_successor(text)
    direct = np.flatnonzero(rising & (text > 0))
    zeros = np.flatnonzero(rising & (text == 0))
    ordered = np.concatenate([zeros, sort_directly(direct, word_keys(text), depth)])
    cuts = np.searchsorted(text[ordered], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for c in range(256):
        fresh = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        head = [fresh]
        while len(fresh):  # suffixes of the same first byte, each induced by its successor
            before = fresh[fresh > 0] - 1
            fresh = before[(text[before] == c) & ~rising[before]]
            head.append(fresh)
        bucket = np.concatenate([*head, ordered[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            to = text[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                induced[to[a]].append(before[a:z])
    return np.concatenate(out)


def adjacent_prefixes(suffixes: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it, up to ``limit`` bytes; 0 for the first."""
    out = np.zeros(len(suffixes), np.int64)
    live = np.arange(1, len(suffixes))
    top = len(keys) - 1
    for at in range(0, limit, 8):
        x = keys[np.minimum(suffixes[live] + at, top)] ^ keys[np.minimum(suffixes[live - 1] + at, top)]
        ends = np.flatnonzero(x)
        out[live] += 8
        out[live[ends]] += (x[ends].byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(1) - 8
        live = live[x == 0]
        if not len(live):
            break
    return np.minimum(out, limit)


def shared_parts(parts: list[bytes], group: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of fragments (fragment, start, end) that may hold strings of LENGTH bytes which others of their group hold too.

    A string that fragments share around their anchor, which lies at ``left``, starts equally far from it in both, so only such places
    are compared, by hash: what has no equal hash is left out, what has one is a candidate.  With ``left`` -1, fragments stay whole.
    """
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    whole = np.flatnonzero(left < 0)
    runs = np.where(left < 0, 0, np.maximum(0, np.minimum(left, sizes - LENGTH) + 1))  # starts from the left end up to the anchor
    which = np.repeat(np.arange(len(parts)), runs)
    start = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    prefix = common.prefix_hash(np.frombuffer(b"".join(parts), np.uint8))
    at = begin[which] + start
    h = common.span_hash(prefix, at, at + LENGTH) ^ common.mix(group[which].astype(U64) * U64(512) + (left[which] - start).astype(U64))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(which), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    which, start = which[shared], start[shared]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which)) - 1 if len(first) else first
    return np.concatenate([whole, which[first]]), np.concatenate([0 * whole, start[first]]), np.concatenate([sizes[whole], start[last] + LENGTH])


def later_strings(parts: list[bytes], d: np.ndarray, a: np.ndarray, group: np.ndarray | None = None, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the fragments' strings of LENGTH bytes that start earlier (by document, then place) in another place too.

    ``group`` numbers the fragments of one anchor, which lies at ``left``; without them any two fragments may share any string.  Of parts
    of a group with the same bytes the earliest alone is sorted: all of the others starts earlier there.
    """
    if left is None:
        return _sorted_strings(parts, d, a)
    which, start, end = shared_parts(parts, group, left)
    order = np.lexsort((a[which] + start, d[which], group[which]))
    own, place = d[which], a[which] + start
    firsts: dict[tuple[int, bytes], int] = {}
    again = []
    for k, i, x, z, g in zip(order.tolist(), which[order].tolist(), start[order].tolist(), end[order].tolist(), group[which][order].tolist(), strict=True):
        first = firsts.setdefault((g, parts[i][x:z]), k)
        if (own[first], place[first]) != (own[k], place[k]):  # contexts of a document that overlap may give the same part
            again.append(k)
    kept = list(firsts.values())
    found = _sorted_strings([part for _, part in firsts], own[kept], place[kept])
    return tuple(np.concatenate([x, y]) for x, y in zip(found, (own[again], place[again], (a[which] + end)[again]), strict=True))


def _sorted_strings(parts: list[bytes], d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of ``later_strings`` by the order of all suffixes and their adjacent common prefixes."""
    if not parts:
        return d[:0], a[:0], a[:0]
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join([p.translate(_SHIFTED) for p in parts]) + b"\0", np.uint8)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    order = suffix_array(text, LENGTH)
    starts = np.zeros(len(text), bool)
    runs = np.maximum(sizes - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(parts)), runs)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts[begin[which] + offset] = True
    order = order[starts[order]]
    if len(order) < 2:
        return d[:0], a[:0], a[:0]
    equal = adjacent_prefixes(order, word_keys(text), LENGTH) >= LENGTH
    owner = np.searchsorted(begin, order, "right") - 1
    ranks = np.unique(d, return_inverse=True)[1]
    place = (ranks[owner] << 40) | (a[owner] + order - begin[owner])
    first = np.flatnonzero(~equal)
    least = np.minimum.reduceat(place, first)
    later = place > least[np.cumsum(~equal) - 1]
    return repeats.merged_spans(d[owner[later]], (a[owner] + order - begin[owner])[later], LENGTH)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copy, spans in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.encode()
            runs: list[list[int]] = []
            if copy:
                runs = [[0, len(data)]] if len(data) >= LENGTH else []
            for a, z in sorted((s["a"], s["z"]) for s in spans if not copy):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(z, runs[-1][1])
                elif z - a >= LENGTH:
                    runs.append([a, z])
            kept, at = hashlib.sha256(), 0
            for a, z in runs:
                kept.update(data[at:a])
                at = z
            kept.update(data[at:])
            rows.append((len(data), sum(z - a for a, z in runs), len(runs), kept.hexdigest()))
        n, removed, count, digest = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (d, text): the keys that are copies of earlier texts, and spans (d, a, z) of repeated bytes of the others."""
    copies = repeats.copies_of(docs)
    heads = docs.join(common.maybe_broadcast(copies), "d", "left_anti")
    marked = common.table(repeats.mark(repeats.anchors(heads, UNITS).withColumn("old", F.lit(False)), UNITS))
    return copies, repeats.settled(heads, marked, UNITS, later_strings)[0]


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a LENGTH-byte string that also starts earlier (in a document with a smaller key, or earlier in the
    same one) goes.  Null texts count as empty; texts of fewer than LENGTH bytes are left alone.  Null keys
    sort first; equal rows with one key are judged as one, and different texts with one key as documents in the order of their
    SHA-256.  Other columns are ignored, an empty table gives an empty result.
    """
    common.prepare(docs.sparkSession)
    source, plain, _ = common.keyed(docs, key, text)
    copies, spans = find_repeats(plain)
    schema = f"k {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.apply_spans(source, copies, spans, _finish, schema).withColumnRenamed("k", key)
