"""Where long runs of units (bytes or words) occur more than once, for the two substring operators.

Any repeated run of ``length`` units holds the same anchor in each of its occurrences: the gram of ``gram`` units with the
least hash among those in it (winnowing).  So only anchors are dealt out, about two for every length - gram + 2 units.
An anchor's context is all that runs in which it is the least can reach; a context that occurs again is a repeat as a whole.

Hashes only propose.  A context that a task's own rows have held before is compared with it there, byte by byte, and is not dealt
out again, so that a passage of very many documents reaches its anchors' task once for each task that read it.  Equal hashes of
different tasks become maximal runs of a document that lie equally in an earlier one; the texts of both are read once more, and
a run counts if the SHA-256 digests of its units there agree.  Anchors of runs that do not (hashes collided) have all their
contexts compared unit by unit, as those have that differ in their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
#: Bytes of text whose anchors are found at once; a longer document is handled alone.
BLOCK = 1 << 19
#: Contexts that a task remembers to compare later rows with, and their most bytes.
REMEMBERED, REMEMBERED_BYTES = 20_000, 1 << 12


class Text:
    """A block of items as units: the bytes behind them, and where units and items begin and end."""

    def __init__(self, data: np.ndarray, at: np.ndarray, words: bool) -> None:
        self.words = words
        if words:
            starts, ends, self.first = common.word_spans(data, at)
            self.data, self.starts, self.ends = common.joined_words(data, starts, ends)
        else:
            self.data, self.first = data, at

    def prefix(self) -> np.ndarray:
        """Prefix hashes of the units."""
        return common.prefix_hash(common.word_hashes(self.data, self.starts, self.ends) if self.words else self.data)

    def ranges(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the units ``a:z`` (not empty)."""
        return (self.starts[a], self.ends[z - 1]) if self.words else (a, z)


@dataclass(frozen=True)
class Units:
    """What runs are made of: ``length`` units of a repeated run, ``gram`` units of an anchor, and whether units are words.

    ``strict``: only runs of other, earlier documents count as earlier.  ``hot``: an anchor with more contexts than this is
    compared run by run in many tasks.
    """

    length: int
    gram: int
    words: bool
    strict: bool
    hot: int


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over each ``width`` consecutive values."""
    n = len(x)
    rows = -(-n // width)
    pad = np.full(rows * width, np.iinfo(U64).max if op is np.minimum else 0, U64)
    pad[:n] = x
    grid = pad.reshape(rows, width)
    ahead = op.accumulate(grid, 1).ravel()
    behind = op.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(prefix: np.ndarray, first: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """Of items with the units ``first[i]:first[i + 1]``: anchor hash, context hash, item, anchor's place, context's start and end.

    Places count from the block's first unit.  A run counts for the anchor that is least in it, so a context ends where a
    neighbouring anchor is less; anchors that no run is left to are not given.
    """
    none = (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 4
    n, width = len(prefix) - 1, units.length - units.gram + 1
    if n < units.length:
        return none
    begin = np.arange(n - units.gram + 1)
    h = common.span_hash(prefix, begin, begin + units.gram) | U64(1)
    least = _sliding(h, width, np.minimum)  # by the start of a run; 0 where a run would leave its item
    runs = np.zeros(n + 1, np.int64)
    long = np.diff(first) >= units.length
    np.add.at(runs, first[:-1][long], 1)
    np.add.at(runs, first[1:][long] - units.length + 1, -1)
    least[np.cumsum(runs)[: len(least)] == 0] = 0
    padded = np.zeros(len(h) + width - 1, U64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(h == _sliding(padded, width, np.maximum)[: len(h)])
    if not len(at):
        return none
    item = np.searchsorted(first, at, "right") - 1
    least = h[at]
    low, start = np.maximum(at - (width - 1), first[item]), np.minimum(at, first[item + 1] - units.length)  # first and last start of a run
    same = item[1:] == item[:-1]
    low[1:] = np.where(same & (least[:-1] < least[1:]), np.maximum(low[1:], at[:-1] + 1), low[1:])
    start[:-1] = np.where(same & (least[1:] < least[:-1]), np.minimum(start[:-1], at[1:] - width), start[:-1])
    some = low <= start
    at, item, least, low, start = (x[some] for x in (at, item, least, low, start))
    high = start + units.length
    context = common.span_hash(prefix, low, high) ^ common.mix((at - low).astype(U64) + U64(1))
    return least, context, item, at, low, high


class _Seen:
    """Contexts that occurred more than once in a task's rows: their documents and bytes, by hash, for later rows."""

    def __init__(self) -> None:
        self.d: dict[int, int] = {}
        self.part: dict[int, bytes] = {}

    def add(self, x: np.ndarray, d: np.ndarray, a: np.ndarray, z: np.ndarray, raw: np.ndarray) -> None:
        if len(self.d) + len(x) > REMEMBERED:
            self.d, self.part = {}, {}
        for k, doc, i, j in zip(x.tolist(), d.tolist(), a.tolist(), z.tolist(), strict=True):
            if j - i <= REMEMBERED_BYTES and doc < self.d.get(k, 1 << 63) and len(self.d) < REMEMBERED:
                self.d[k], self.part[k] = doc, raw[i:j].tobytes()

    def repeats(self, x: np.ndarray, d: np.ndarray, a: np.ndarray, z: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Which contexts a remembered, earlier document has, by their bytes."""
        out = np.zeros(len(x), bool)
        if self.d:
            for k in np.flatnonzero(np.isin(x, np.fromiter(self.d, U64, len(self.d)))).tolist():
                key = int(x[k])
                out[k] = self.d[key] < d[k] and self.part[key] == raw[a[k] : z[k]].tobytes()
        return out


def _known(text: Text, units: Units, seen: _Seen, x: np.ndarray, c: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's contexts (by place): which are repeats of others in this task, how many equal ones follow each by one unit, and c.

    Equal contexts one unit apart in one document are taken together: the first stands for all, the others are dropped (-1).
    Contexts that share a hash but not their bytes get another c, so that they count as different ones.
    """
    n = len(x)
    a, z = text.ranges(low, high)
    sure, more = seen.repeats(x, d, a, z, text.data), np.zeros(n, np.int64)
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    if not same.any():
        return sure, more, c
    inside = np.zeros(n, bool)
    inside[1:] |= same
    inside[:-1] |= same
    order = order[inside]  # those in groups of several
    order = order[np.lexsort((low[order], d[order], x[order]))]
    new = np.ones(len(order), bool)
    new[1:] = x[order][1:] != x[order][:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    size = z - a
    equal = (lead != order) & (size[lead] == size[order])
    equal[equal] = common.equal_ranges(text.data, a[order[equal]], a[lead[equal]], size[order[equal]])
    for k in order[(lead != order) & ~equal].tolist():
        c[k] ^= U64(int.from_bytes(hashlib.sha256(text.data[a[k] : z[k]].tobytes()).digest()[:8], "little"))
    if not units.strict:
        sure[order[equal]] = True
    else:
        sure[order[equal & (d[order] > d[lead])]] = True
        chain = np.zeros(len(order), bool)  # equal to its lead, as the one before is, and one unit after it
        chain[1:] = equal[1:] & (equal[:-1] | new[:-1]) & (d[order][1:] == d[order][:-1]) & (low[order][1:] == low[order][:-1] + 1) & ~sure[order][1:] & ~sure[order][:-1]
        heads = np.flatnonzero(~chain)
        more[order[heads]] = np.diff(np.append(heads, len(order))) - 1
        more[order[chain]] = -1
    chosen = np.unique(lead[equal & (d[order] > d[lead])])
    seen.add(x[chosen], d[chosen], a[chosen], z[chosen], text.data)
    return sure, more, c


def _anchors(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            keys = batch.column("d").to_numpy()
            for begin, end, data, at in common.blocks(batch.column("text"), BLOCK):
                text = Text(data, at, units.words)
                h, c, item, place, low, high = anchors_of(text.prefix(), text.first, units)
                d = keys[begin:end][item]
                sure, more, c = _known(text, units, seen, common.mix(h) ^ c, c, d, low, high) if len(h) else (np.zeros(0, bool), np.zeros(0, np.int64), c)
                left, right = place - low, high - place
                place = place - text.first[item]
                q = place << 16 | left << 8 | right
                kept = more >= 0
                columns = (pa.array(h[kept].view(np.int64), mask=sure[kept]), *(pa.array(v[kept]) for v in (c.view(np.int64), d, q, more)))
                yield pa.RecordBatch.from_arrays(list(columns), names=["h", "c", "d", "q", "more"])
    return run


def anchors(source: DataFrame, units: Units) -> DataFrame:
    """Anchors of ``source`` (d, text): hash, context's hash, document, place with its reach to both sides, equal ones that follow.

    Contexts that are known to be repeats, having been compared within the task, have a null h.
    """
    return source.mapInArrow(_anchors(units), "h long, c long, d long, q long, more long")


_MARKS = ("d", "a", "z", "left", "h", "d0", "a0", "e")


def _mark(units: Units):
    """Sorted anchors (h, c, d, q, more, old) to contexts a:z of documents, which with what follows end at e.

    Known repeats have a null h, those equal in their hashes to an earlier one its place (d0, a0), the others are to be compared.
    Nothing is held but the anchors of an unfinished group whose fate is open: the firsts of its contexts.
    """
    def rows(d, q, more, h, lead, chosen, sort):
        at, left, right = q[chosen] >> 16, q[chosen] >> 8 & 255, q[chosen] & 255
        n = len(at)
        none = pa.nulls(n, pa.int64())
        d0, a0 = none, none
        if sort == "equal":
            of = lead[chosen]
            d0, a0 = pa.array(d[of]), pa.array((q[of] >> 16) - (q[of] >> 8 & 255))
        own = (pa.array(v) for v in (d[chosen], at - left, at + right, left))
        return pa.RecordBatch.from_arrays([*own, none if sort == "sure" else pa.array(h[chosen]), d0, a0, pa.array(at + right + more[chosen])], names=list(_MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2
        for batch in _and_end(batches):
            if batch is not None and batch.column("h").null_count:
                sure = batch.filter(pc.is_null(batch.column("h")))
                sd, sq, sm = (sure.column(x).to_numpy() for x in ("d", "q", "more"))
                yield rows(sd, sq, sm, sd, sd, slice(None), "sure")
                batch = batch.filter(pc.is_valid(batch.column("h")))
            own = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("h", "c", "d", "q", "more", "old")] if batch is not None else [x[:0] for x in carry[:6]]
            h, c, d, q, more, old, told = (np.concatenate([a, b]) for a, b in zip(carry, [*own, np.zeros(len(own[0]), bool)], strict=True))
            n = len(h)
            if not n:
                continue
            group = np.ones(n, bool)
            group[1:] = h[1:] != h[:-1]
            context = group.copy()
            context[1:] |= c[1:] != c[:-1]
            index = np.arange(n)
            lead = np.maximum.accumulate(np.where(context, index, 0))
            early = d == d[lead] if units.strict else index == lead
            of = np.cumsum(group) - 1
            several = (np.bincount(of, context) >= 2) & (np.bincount(of, early & ~old) > 0)
            whole = ~early & ~old & ~told
            compare = early & ~told & several[of]
            trailing = of == of[-1]
            keep = np.zeros(n, bool)
            if batch is not None:
                if several[-1]:
                    keep[[np.flatnonzero(trailing)[0], lead[-1]]] = True
                    told, old = told | keep, old & ~keep
                else:
                    keep = trailing & early
            carry = [x[keep] for x in (h, c, d, q, more, old, told)]
            for chosen, sort in ((whole, "equal"), (compare, "other")):
                if chosen.any():
                    yield rows(d, q, more, h, lead, np.flatnonzero(chosen), sort)
    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def mark(rows: DataFrame, units: Units) -> DataFrame:
    """Contexts (d, a, z, left, h, d0, a0, e) from anchors (h, c, d, q, more, old): see ``_mark``."""
    dealt = rows.repartition(F.coalesce("h", F.xxhash64("d", "q"))).sortWithinPartitions("h", "c", "d", "q")
    return dealt.mapInArrow(_mark(units), ", ".join(f"{c} long" for c in _MARKS))


_RUNS = ("d", "a", "z", "d0", "a0", "e")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by document, document of the equal one, distance and place, to maximal runs; one open run is held."""
    carry = [np.zeros(0, np.int64)] * len(_RUNS)
    for batch in _and_end(batches):
        own = [batch.column(x).to_numpy() for x in _RUNS] if batch is not None else [x[:0] for x in carry]
        d, a, z, d0, a0, e = (np.concatenate(x) for x in zip(carry, own, strict=True))
        if not len(d):
            continue
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (d0[1:] != d0[:-1]) | ((a - a0)[1:] != (a - a0)[:-1]) | (a[1:] > z[:-1])
        first = np.flatnonzero(new)
        runs = [d[first], a[first], np.maximum.reduceat(z, first), d0[first], a0[first], np.maximum.reduceat(e, first)]
        if batch is not None:
            carry, runs = [x[-1:] for x in runs], [x[:-1] for x in runs]
        if len(runs[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs], names=list(_RUNS))


def joined(equal: DataFrame) -> DataFrame:
    """Maximal runs (d, a, z, d0, a0, e) of contexts that have equal hashes at equal distances in d and d0."""
    dealt = equal.select(*_RUNS).repartition("d").sortWithinPartitions("d", "d0", F.col("a") - F.col("a0"), "a")
    return dealt.mapInArrow(_joined, ", ".join(f"{c} long" for c in _RUNS))


#: Kinds of fragments: contexts to compare, single runs of them (of hot anchors), digests of runs that should be equal, known repeats.
CONTEXT, RUN, DIGEST, KNOWN = 0, 1, 2, 3
_PLACE = "place struct<kind:int,h:long,x:long,a:long,z:long>"
_PARTS = "kind int, m long, d long, a long, x long, part binary"


def _single_runs(text: Text, units: Units, places: list[tuple[int, int, int, int]], raw: bytes) -> list[tuple]:
    """Fragments of the runs of hot anchors' contexts (item's first unit, d, a, z), combined within the block.

    A run that an earlier document of the block has too is known to be a repeat; equal ones one unit apart are one fragment.
    """
    prefix = text.prefix()
    leads: dict[bytes, int] = {}
    chains: dict[tuple[bytes, int], list] = {}
    out: list[list] = []
    for f, d, low, high in sorted(places, key=lambda p: p[1:]):
        base = np.arange(f + low, f + high - units.length + 1)
        u, v = text.ranges(base, base + units.length)
        marks = common.span_hash(prefix, base, base + units.length).view(np.int64)
        for m, b, i, j in zip(marks.tolist(), (base - f).tolist(), u.tolist(), v.tolist(), strict=True):
            run = raw[i:j]
            lead, chain = leads.setdefault(run, d), chains.get((run, d))
            if chain and b <= chain[3] + chain[4]:
                continue  # met in an overlapping context
            known = lead != d or (chain is not None and not units.strict)
            if chain and known == (chain[0] == KNOWN) and b == chain[3] + chain[4] + 1:
                chain[4] += 1
            else:
                chain = [KNOWN if known else RUN, d if known else m, d, b, 0, f]
                chains[run, d] = chain
                out.append(chain)
    rows = []
    for kind, m, d, b, more, f in out:
        i, j = (int(v[0]) for v in text.ranges(np.array([f + b]), np.array([f + b + units.length + more])))
        rows.append((kind, m, d, b, b + units.length + more if kind == KNOWN else 0, b"" if kind == KNOWN else raw[i:j]))
    return rows


def _fragments(units: Units):
    """Texts with places to fragments (kind, m, d, a, x, part); of a digest m, a and d are the place and size of the earlier run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column("d").to_numpy(), batch.column("places")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            kind, h, x, a, z = (flat.field(k).to_numpy() for k in range(5))
            for begin, end, data, at in common.blocks(batch.column("text")):
                text = Text(data, at, units.words)
                own = slice(offsets[begin], offsets[end])
                item = np.repeat(np.arange(end - begin), np.diff(offsets[begin : end + 1]))
                k, m, at_x, low, high, d = kind[own], h[own], x[own], a[own], z[own], keys[begin:end][item]
                room = np.diff(text.first)[item]  # a place beyond the text's end can only follow from a collision
                fits = high <= room
                i, j = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                i[fits], j[fits] = text.ranges((text.first[item] + low)[fits], (text.first[item] + high)[fits])
                raw, rows, told = text.data.tobytes(), [], set()
                for n in np.flatnonzero(k == CONTEXT).tolist():
                    rows.append((CONTEXT, m[n], d[n], low[n], at_x[n], raw[i[n] : j[n]]))
                for n in np.flatnonzero(k == DIGEST).tolist():
                    row = (DIGEST, m[n], high[n] - low[n], at_x[n], 0, hashlib.sha256(raw[i[n] : j[n]]).digest())
                    if row not in told:
                        told.add(row)
                        rows.append(row)
                hot = np.flatnonzero(k == RUN)
                if len(hot):
                    rows += _single_runs(text, units, [(text.first[item[n]], d[n], low[n], high[n]) for n in hot.tolist()], raw)
                for n in range(0, len(rows), 20_000):
                    columns = zip(*rows[n : n + 20_000], strict=True)
                    types = (pa.int32(), *[pa.int64()] * 4, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "m", "d", "a", "x", "part"])
    return run


def fragments(source: DataFrame, compare: DataFrame, runs: DataFrame | None, units: Units) -> DataFrame:
    """Fragments of ``source`` (d, text) for contexts to ``compare`` (h, d, a, e, left) and for both sides of ``runs``.

    The earlier side of equal runs is read once, however many documents hold it, and its places are distinct before they are dealt out.
    """
    hot = common.cut(compare.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > units.hot).select("h", F.lit(RUN).alias("kind")))
    place = lambda kind, h, x, a, z: F.struct(kind.cast("int").alias("kind"), h.alias("h"), x.alias("x"), a.alias("a"), z.alias("z")).alias("place")
    c = F.col
    places = compare.join(common.maybe_broadcast(hot), "h", "left").select("d", place(F.coalesce("kind", F.lit(CONTEXT)), c("h"), c("left"), c("a"), c("e")))
    if runs is not None:
        size = c("z") - c("a")
        own = runs.select("d", place(F.lit(DIGEST), c("d0"), c("a0"), c("a"), c("z")))
        earlier = runs.select(c("d0").alias("d"), "a0", size.alias("n")).distinct().select("d", place(F.lit(DIGEST), c("d"), c("a0"), c("a0"), c("a0") + c("n")))
        places = places.unionAll(own).unionAll(earlier)
    places = common.table(places.groupBy("d").agg(F.collect_list("place").alias("places")))
    wanted = source.join(common.maybe_broadcast(places.select(F.col("d").alias("id"))), F.col("d") == F.col("id"), "left_semi")
    return wanted.join(places, "d").select("d", "text", "places").mapInArrow(_fragments(units), _PARTS)


#: Bytes of fragments compared at once; a group is not cut but for hot anchors, whose groups are copies of one run.
CHUNK = 4 << 20

Compare = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _compare(compare: Compare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(rows, failed: bool = False) -> pa.RecordBatch:
            d, a, z = rows
            return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (d, a, z)), pa.array([failed] * len(d), pa.bool_())], names=["d", "a", "z", "failed"])

        def compared() -> pa.RecordBatch:
            kind, m, d, a, x, parts = zip(*held, strict=True)
            group = np.cumsum([True, *(p != q for p, q in zip(m[1:], m, strict=False))])
            return spans(compare(list(parts), np.array(d), np.array(a), group, np.where(np.array(kind) == CONTEXT, np.array(x), -1)))

        held: list[tuple] = []
        size, now, first = 0, None, None
        for batch in batches:
            failed: list[tuple] = []
            known: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "m", "d", "a", "x", "part")), strict=True):
                kind, m, d, a, x, part = row
                if kind == DIGEST:
                    if now == (kind, m, d, a):
                        if part != first and (not failed or failed[-1] != (m, a, a + d)):
                            failed.append((m, a, a + d))
                    else:
                        now, first = (kind, m, d, a), part
                    continue
                if kind == KNOWN:
                    known.append((d, a, x))
                    continue
                new = now != (kind, m)
                if size >= CHUNK and (new or kind == RUN):
                    yield compared()
                    held = [] if new else [first]
                    size = sum(len(r[-1]) for r in held)
                if new:
                    now, first = (kind, m), row
                held.append(row)
                size += len(part)
            if failed:
                yield spans(zip(*failed, strict=True), True)
            if known:
                yield spans(zip(*known, strict=True))
        if held:
            yield compared()
    return run


def compared(parts: DataFrame, compare: Compare) -> DataFrame:
    """Spans (d, a, z) of runs in fragments that ``compare`` finds to be later occurrences, and earlier runs whose digests failed."""
    dealt = parts.repartition("kind", "m", F.when(F.col("kind") == DIGEST, F.col("a"))).sortWithinPartitions("kind", "m", "d", "a")
    return dealt.mapInArrow(_compare(compare), "d long, a long, z long, failed boolean")


def settled(source: DataFrame, marked: DataFrame, units: Units, compare: Compare, collided: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Spans (d, a, z) of repeated runs in ``source`` (d, text) from its marked contexts, all checked on the units themselves.

    Also the anchors (h) of which different contexts are known to share hashes: those in ``collided``, and those found here.
    All contexts of theirs in ``source`` are compared.
    """
    known = marked.where("h IS NULL").select("d", "a", F.col("e").alias("z"))
    runs = common.table(joined(marked.where("d0 IS NOT NULL")))
    out = common.table(compared(fragments(source, marked.where("h IS NOT NULL AND d0 IS NULL"), runs, units), compare))
    failed = common.cut(out.where("failed").select(F.col("d").alias("fd"), F.col("a").alias("fa"), F.col("z").alias("fz")).distinct())
    found = out.where("NOT failed").select("d", "a", "z")
    if not failed.isEmpty():
        hit = marked.where("d0 IS NOT NULL").join(failed, F.expr("d0 = fd AND a0 >= fa AND a0 < fz")).select("h").distinct()
        collided = common.cut(hit if collided is None else hit.unionAll(collided).distinct())
        runs = runs.join(failed, F.expr("d0 = fd AND a0 = fa AND z - a = fz - fa"), "left_anti")
    if collided is not None:
        every = anchors(source, units).join(collided, "h", "left_semi")
        start = F.expr("shiftright(q, 16) - (shiftright(q, 8) & 255)")
        contexts = every.select("h", "d", start.alias("a"), F.expr("shiftright(q, 16) + (q & 255) + more").alias("e"), F.expr("shiftright(q, 8) & 255").alias("left"))
        found = found.unionAll(compared(fragments(source, common.table(contexts), None, units), compare).select("d", "a", "z"))
    return known.unionAll(runs.select("d", "a", F.col("e").alias("z"))).unionAll(found), collided


def merged_spans(d: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal spans covered by runs of ``length`` units that start at ``start`` in documents ``d``."""
    if not len(d):
        return d, start, start
    order = np.lexsort((start, d))
    d, start = d[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], start[first], start[last] + length


def copies_of(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (d, text), the keys of those whose text an earlier row has as a whole."""
    prints = rows.select("d", F.sha2("text", 256).alias("s"))
    heads = prints.groupBy("s").agg(F.min("d").alias("head"), F.count("*").alias("n")).where("n > 1")
    return common.cut(prints.join(heads, "s").where("d <> head").select("d").distinct())


def apply_spans(docs: DataFrame, copies: DataFrame, spans: DataFrame, finish, schema: str) -> DataFrame:
    """``docs`` (k, d, text) with their spans (array of a, z) and whether they are copies, through ``finish``.

    Only the texts that have spans are dealt out with them; the others are finished where they are read.
    """
    grouped = common.table(spans.groupBy("d").agg(F.collect_list(F.struct("a", "z")).alias("spans")))
    marked = docs.join(common.maybe_broadcast(copies.withColumn("copy", F.lit(True))), "d", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    ids = common.maybe_broadcast(grouped.select(F.col("d").alias("id")))
    none = F.expr("cast(array() as array<struct<a:bigint,z:bigint>>)")
    without = marked.join(ids, F.col("d") == F.col("id"), "left_anti").select("k", "text", "copy", none.alias("spans"))
    those = marked.join(ids, F.col("d") == F.col("id"), "left_semi").join(grouped, "d").select("k", "text", "copy", "spans")
    return without.mapInArrow(finish, schema).unionAll(those.mapInArrow(finish, schema))
