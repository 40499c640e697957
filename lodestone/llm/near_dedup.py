"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

A document's set is its distinct shingles.  A sketch has SKETCH coordinates.  In its first SKETCH rounds each shingle is put
into one hashed coordinate with a value of that round; in the next SKETCH rounds into a fixed one, so that every coordinate
is filled; a coordinate keeps its least value.  Coordinates agree with the probability of the sets' similarity and
concentrate like independent ones.  Sketches agreeing in a whole band are candidates; a pair is linked only once the full
sets have been compared.

Texts of the same words are one class from the start, by the SHA-256 of those words.  Round one compares each member
of a bucket with the bucket's first one; components of the confirmed links follow.  Round two compares, within a bucket, only
members of different components, and only where parity sketches, which bound the shingles in which sets differ, do not
rule similarity out; a similar pair always passes.  Those left are confirmed on full sets too, so links between classes that
round one left apart are found, and none is dropped.  Sets are counted and compared on the shingles' bytes; their hashes only propose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a shingle and least similarity in hundredths, as used elsewhere.
SHINGLE, PERCENT = 5, 80
#: Coordinates of a sketch, and coordinates of a band: a pair at 0.8 is missed with a chance of (1 - 0.8**4)**32 < 1e-7.
SKETCH, ROWS = 128, 4
#: Bits of a parity sketch: each shingle flips one, so sketches differ in no more bits than sets in shingles.
PARITY = 1024
#: Rounds of label propagation before the caller is told that something is wrong.
MAX_ROUNDS = 60

#: Bytes of text whose sets are made at once.
BLOCK = 1 << 19

U64 = np.uint64


@dataclass
class Sets:
    """The shingle sets of a block's items: distinct hashes, sorted within each item, and the bytes behind them.

    Item i has the hashes ``first[i]:first[i + 1]``, whose shingles are ``data[a:z]``, and ``n[i]`` distinct shingles: more than
    hashes only where shingles of one item share a hash.
    """

    data: np.ndarray
    h: np.ndarray
    a: np.ndarray
    z: np.ndarray
    first: np.ndarray
    n: np.ndarray
    words: list[tuple[int, int]]
    size: int

    @classmethod
    def of(cls, raw: np.ndarray, at: np.ndarray, size: int) -> Sets:
        """A-Z count as a-z; words are what white space separates; an item of fewer than ``size`` words has its whole sequence as one."""
        low = common.LOWER[raw]
        starts, ends, own = common.word_spans(low, at)
        data, starts, ends = common.joined_words(low, starts, ends)
        prefix = common.prefix_hash(common.word_hashes(data, starts, ends))
        items, n = len(own) - 1, np.diff(own)
        count = np.where(n > 0, np.maximum(1, n - size + 1), 0)
        item = np.repeat(np.arange(items), count)
        begin = own[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        end = np.minimum(begin + size, own[item + 1])
        h = common.span_hash(prefix, begin, end)
        order = np.lexsort((h, item))
        h, item, a, z = h[order], item[order], starts[begin[order]], ends[end[order] - 1]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        again = np.flatnonzero(~new)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))[again]
        equal = z[again] - a[again] == z[lead] - a[lead]
        equal[equal] = common.equal_ranges(data, a[again[equal]], a[lead[equal]], (z - a)[again[equal]])
        first = np.searchsorted(item[new], np.arange(items + 1))
        words = [(int(starts[x]), int(ends[y - 1])) if y > x else (0, 0) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
        out = cls(data, h[new], a[new], z[new], first, np.diff(first), words, size)
        for i in set(item[again[~equal]].tolist()):
            out.n[i] = len(out.shingles(i))
        return out

    def text(self, i: int) -> bytes:
        """The item's words, joined by single spaces."""
        a, z = self.words[i]
        return self.data[a:z].tobytes()

    def shingles(self, i: int) -> set[bytes]:
        """The item's set itself."""
        words = self.text(i).split(b" ")
        return {b" ".join(words[k : k + self.size]) for k in range(max(1, len(words) - self.size + 1))} if words != [b""] else set()

    def hashes(self, i: int) -> np.ndarray:
        return self.h[self.first[i] : self.first[i + 1]]

    def similar(self, i: int, other: Sets, j: int, percent: int) -> bool:
        """Whether item i is similar enough to item j of ``other``, on their shingles' bytes."""
        x, y = self.hashes(i), other.hashes(j)
        n, m = int(self.n[i]), int(other.n[j])
        enough = lambda shared: 100 * shared >= percent * (n + m - shared)
        if (n, m) != (len(x), len(y)):
            return enough(len(self.shingles(i) & other.shingles(j)))
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = np.flatnonzero(y[at] == x) if len(y) else at[:0]
        if not enough(len(both)):
            return False
        both, at = both + self.first[i], at[both] + other.first[j]
        size = self.z[both] - self.a[both]
        same = size == other.z[at] - other.a[at]
        low, from_ = self.words[i][0], other.words[j][0]
        mine, theirs = self.data[low : self.words[i][1]], other.data[from_ : other.words[j][1]]
        same[same] = common.equal_ranges(mine, self.a[both[same]] - low, other.a[at[same]] - from_, size[same], theirs)
        return enough(int(same.sum()))


_SALTS = common.mix(np.arange(1, 2 * SKETCH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: a value for each coordinate, its upper bits the round."""
    out = np.full(size, np.iinfo(np.uint64).max, U64)
    free = size
    per = max(1, min(size, -(-7 * size // len(h))))  # seven shingles for each coordinate fill nearly all
    for r in range(0, size, per):
        rounds = np.arange(r, min(size, r + per), dtype=np.int64)
        v = common.mix(h[None, :] ^ _SALTS[rounds][:, None])
        at = (v & U64(size - 1)).astype(np.int64)
        value = (rounds.astype(U64)[:, None] << U64(48)) | (v >> U64(16))
        np.minimum.at(out, at.ravel(), value.ravel())
        free = int((out == np.iinfo(np.uint64).max).sum())
        if not free:
            return out
    for k in np.flatnonzero(out == np.iinfo(np.uint64).max).tolist():
        out[k] = (U64(size + k) << U64(48)) | (common.mix(h ^ _SALTS[size + k]) >> U64(16)).min()
    return out


def _sets(size: int):
    """Key, set size, digest of the words, bands and parity sketch of each row; no bands and no digest for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, bands, odd = [], [], [], []
            for _, _, data, at in common.blocks(batch.column("text"), BLOCK):
                sets = Sets.of(data, at, size)
                n += sets.n.tolist()
                for i in range(len(sets.n)):
                    own = sets.hashes(i)
                    if not len(own):
                        ids.append(None), bands.append([]), odd.append([])
                        continue
                    ids.append(hashlib.sha256(sets.text(i)).digest())
                    s = common.mix(sketch(own))
                    prefix = s.reshape(-1, ROWS).copy()
                    for k in range(1, ROWS):
                        prefix[:, 0] = common.mix(prefix[:, 0] * U64(31) + prefix[:, k])
                    bands.append(prefix[:, 0].view(np.int64))
                    flips = np.bincount((own & U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                    odd.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("k"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())),
            ], names=["k", "n", "id", "bands", "odd"])
    return run


def _verify(size: int, percent: int):
    """Pairs sorted by the side that many share: those whose full sets are similar enough.  A set is remembered while its key lasts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            shared = zip(batch.column("b").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
            good = []
            for _, _, data, at in common.blocks(batch.column("text_a"), BLOCK):
                sets = Sets.of(data, at, size)
                for i in range(len(sets.n)):
                    key, text = next(shared)
                    if last is None or key != last:
                        last, mine = key, Sets.of(*common.buffers(pa.array([text], pa.large_string())), size)
                    good.append(sets.similar(i, mine, 0, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, source: DataFrame, size: int, percent: int, kind: str) -> DataFrame:
    """The pairs (a, b; a checkpoint) whose sets, from the texts in ``source`` (k, text), are similar enough."""
    both = pairs
    for own, other in (("a", "b"), ("b", "a")):
        side = source.select(F.col("k").alias(own), F.col("text").alias(f"text_{own}"))
        counts = pairs.groupBy(own).agg(F.count("*").alias("m"))
        both = common.dealt_join(both, side, [own], other, counts)
    return both.select("a", "b", "text_a", "text_b").sortWithinPartitions("b").mapInArrow(_verify(size, percent), f"a {kind}, b {kind}")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (v, c: any component so far) with the least c reachable over ``links`` (a, b).

    Each round a node takes the least label among its neighbours' and then its label's own label, so distances halve; hot
    nodes and labels only enter reductions and dealt joins.
    """
    size, both = nodes.count(), 2 * links.count()
    links = common.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), both)
    degrees = links.groupBy("b").agg(F.count("*").alias("m"))
    labels = nodes
    for _ in range(MAX_ROUNDS):
        near = common.dealt_join(links, labels.select(F.col("v").alias("b"), "c"), ["b"], "a", degrees)
        near = near.groupBy("a").agg(F.min("c").alias("near")).withColumnRenamed("a", "v")
        stepped = common.cut(labels.join(near, "v", "left").select("v", "c", F.least("c", "near").alias("new")), size)
        jump = common.cut(stepped.groupBy("c").agg(F.min("new").alias("to"), F.count("*").alias("m")), size)  # what a label's holders have met
        moved = common.dealt_join(stepped, jump, ["c"], "v", jump).select("v", F.col("c").alias("old"), F.least("new", "to").alias("c"))
        moved = common.cut(moved, size)
        if moved.where("c < old").isEmpty():
            return moved.select("v", "c")
        labels = moved.select("v", "c")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Rows are linked if 100 * shared shingles >= percent * all shingles of both; component_id is the smallest key reachable
    over links, and kept marks the row that has it.  Null and empty texts, and those of white space alone, are linked with nothing.
    A null key comes before all others.  Equal rows with one key are one document (all kept or none), different texts with one key
    are documents in the order of their SHA-256.  Other columns are ignored, and an empty table gives an empty result.
    """
    common.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows, plain, names = common.keyed(docs, key, text)
    source = plain.select(F.col("d").alias("k"), "text")
    sets = common.cut(source.mapInArrow(_sets(size), "k long, n long, id binary, bands array<long>, odd array<long>"))
    full = sets.where("n > 0")
    # classes of the same words; their first key stands for all
    classes = common.cut(full.groupBy("id").agg(F.min("k").alias("v"), F.count("*").alias("m")))
    heads = common.cut(full.join(classes.select(F.col("v").alias("k")), "k", "left_semi").select(F.col("k").alias("v"), "n", "bands", "odd"))
    of_words = classes.count()
    banded = heads.select("v", "n", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min(F.struct("v", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    buckets = common.cut(buckets.select("band", "h", F.col("lead.v").alias("lead"), F.col("lead.n").alias("lead_n"), "m"), SKETCH // ROWS * of_words // 2)
    members = common.cut(common.dealt_join(banded, buckets, ["band", "h"], "v", buckets).select("v", "n", "band", "h", "lead", "lead_n"))
    stars = members.where(f"v <> lead AND 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)").select(F.col("v").alias("a"), F.col("lead").alias("b"))
    stars = common.cut(stars.distinct())
    near = common.cut(members.select(F.col("v").alias("k")).distinct(), of_words)
    wanted = source.join(common.maybe_broadcast(near), "k", "left_semi")
    links = common.cut(confirmed(stars, wanted, size, percent, "long"))
    labels = components(near.select(F.col("k").alias("v"), F.col("k").alias("c")), links)
    # round two: between components, within buckets; members of the bucket's largest component are not compared with one another
    held = common.cut(members.select("v", "n", "band", "h").join(labels, "v"))
    split = held.groupBy("band", "h", "c").agg(F.count("*").alias("m")).groupBy("band", "h")
    split = split.agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("m"), F.count("*").alias("groups")).where("groups > 1")
    split = common.cut(split.select("band", "h", F.col("most.c").alias("major"), "m"), buckets.count())
    left = common.dealt_join(held, split, ["band", "h"], "v", split)
    left = common.table(left.join(heads.select("v", "odd"), "v").withColumn("parts", F.ceil(F.col("m") / common.HOT_ROWS).cast("int")))
    one = left.where("c <> major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one = one.select("band", "h", "part", "major", *(F.col(c).alias(f"{c}_b") for c in ("v", "n", "odd", "c")))
    two = left.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    two = two.select("band", "h", "part", *(F.col(c).alias(f"{c}_a") for c in ("v", "n", "odd", "c")))
    # similar sets differ in at most (100 - percent) hundredths of their union, which has at most 100 / percent times the smaller
    flips = " + ".join(f"bit_count(odd_a[{k}] ^ odd_b[{k}])" for k in range(PARITY // 64))
    apart = F.expr(f"c_a <> c_b AND (c_a = major OR c_a < c_b) AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {percent} * ({flips}) <= {100 - percent} * least(n_a, n_b)")
    pairs = one.join(two, ["band", "h", "part"]).where(apart).select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct()
    more = common.cut(confirmed(common.cut(pairs), wanted, size, percent, "long"))
    if not more.isEmpty():
        labels = components(labels, links.union(more))
    named = classes.join(labels, "v", "left").select("id", F.coalesce("c", "v").alias("c"))
    found = common.dealt_join(full.select(F.col("k").alias("d"), "n", "id"), named, ["id"], "d", classes).select("d", "n", "c")
    found = found.unionAll(sets.where("n = 0").select(F.col("k").alias("d"), "n", F.col("k").alias("c")))
    out = rows.select("k", "d").join(found, "d")
    if names is None:
        smallest = F.when(F.col("c") != common.NULL_KEY, F.col("c")).cast(kind)
    else:
        own = names.select(F.col("d").alias("c"), F.col("k").alias("own")).distinct()
        out, smallest = common.dealt_join(out, own, ["c"], "d", out.groupBy("c").agg(F.count("*").alias("m"))), F.col("own")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), smallest.alias("component_id"), (F.col("d") == F.col("c")).alias("kept"))
