"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of CHUNK bytes.  Each chunk's polynomial hash is computed by itself, and the hash of a
longer string follows from its parts by length-shifted arithmetic, H(a+b) = H(a) * B**len(b) + H(b).  Chunks of a text of
more than HUGE bytes are dealt out, hashed anywhere and in any order, and combined by their numbers.  Texts that share a fingerprint are then compared chunk by chunk:
for each fingerprint and chunk number the least and the greatest chunk are kept (an associative reduction, so that no
task ever gathers a group), and a fingerprint for which they differ is split by the texts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Bytes of text beyond which chunks are hashed as rows of their own.
HUGE = 1 << 22
#: Two prime moduli below 2**31 and a base for each.
MODULI = ((2_147_483_647, 1_000_003_177), (2_147_483_629, 777_767_777))

_WHITE = " \t\n\r\x0b\x0c".encode()


def normalise(text: str | None) -> bytes:
    r"""UTF-8 of the text after each ``[\x20\x09-\x0D]+`` has become one space; empty for null."""
    raw = (text or "").encode()
    if not raw:
        return raw
    body = b" ".join(raw.split())
    if not body:
        return b" "
    return (b" " if raw[0] in _WHITE else b"") + body + (b" " if raw[-1] in _WHITE else b"")


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    step = base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step) % np.uint64(modulus)
        have += take
        step = step * step % modulus
    return out


_TABLES: list[np.ndarray] = []


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """The polynomial hashes of one chunk (at most CHUNK bytes)."""
    if not _TABLES:
        _TABLES.extend(_powers(base, modulus, CHUNK)[::-1].copy() for modulus, base in MODULI)
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((values * table[CHUNK - len(values) :]).sum()) % modulus for table, (modulus, _) in zip(_TABLES, MODULI, strict=True))


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """The hashes of the concatenation of two strings, from theirs and the right one's length."""
    return tuple((x * pow(base, right_length, modulus) + y) % modulus for x, y, (modulus, base) in zip(left, right, MODULI, strict=True))


def fingerprint(data: bytes) -> int:
    """The combined hashes of all chunks, as one signed 64-bit number."""
    total = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        total = combine(total, chunk_hash(part), len(part))
    return _number(total)


def _number(hashes: tuple[int, int]) -> int:
    return (hashes[0] << 31) | hashes[1]


_PRINTS = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])


def _prints(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normalise(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array([fingerprint(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
            ], names=[key, *_PRINTS.names])
    return run


_TEXT = ["row", "k", "n_bytes", "text_sha256"]


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of huge texts, each with what is known of its text."""
    for batch in batches:
        for n in range(batch.num_rows):
            data = normalise(batch.column("text")[n].as_py())
            row, k, size, digest = batch.column("row").slice(n, 1), batch.column("k").slice(n, 1), pa.array([len(data)], pa.int64()), pa.array([hashlib.sha256(data).hexdigest()])
            for at in range(0, len(data), CHUNK):
                yield pa.RecordBatch.from_arrays([row, k, size, digest, pa.array([at // CHUNK], pa.int32()), pa.array([data[at : at + CHUNK]], pa.binary())], names=[*_TEXT, "chunk_no", "chunk"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column("chunk").to_pylist()
        x, y = zip(*map(chunk_hash, chunks), strict=True) if chunks else ((), ())
        arrays = [*(batch.column(c) for c in (*_TEXT, "chunk_no")), *(pa.array(v, pa.int64()) for v in (map(len, chunks), x, y))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*_TEXT, "chunk_no", "size", "x", "y"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        for parts in batch.column("parts").to_pylist():
            total = (0, 0)
            for p in parts:
                total = combine(total, (p["x"], p["y"]), p["size"])
            prints.append(_number(total))
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(prints, pa.int64()), batch.column("n_bytes"), batch.column("text_sha256")], names=["k", *_PRINTS.names])


def _huge_prints(huge: DataFrame, kind: str) -> DataFrame:
    """What _prints gives, for texts (k, text) whose chunks are dealt over all tasks."""
    own = f"row long, k {kind}, n_bytes long, text_sha256 string, chunk_no int"
    chunks = huge.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_apart, f"{own}, chunk binary")
    hashed = chunks.repartition("row", "chunk_no").mapInArrow(_hashed, f"{own}, size long, x long, y long")
    parts = hashed.groupBy(*_TEXT).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "size", "x", "y"))).alias("parts"))
    return parts.mapInArrow(_folded, f"k {kind}, fp long, n_bytes long, text_sha256 string")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fp, n, text in zip(batch.column("fp").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = normalise(text)
            parts = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)] or [b""]
            yield pa.RecordBatch.from_arrays([
                pa.array([fp] * len(parts), pa.int64()), pa.array([n] * len(parts), pa.int64()),
                pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()),
            ], names=["fp", "n_bytes", "chunk_no", "chunk"])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to one another, texts of white space alone to one space.  Of equal
    texts the row with the smallest key stays; if a key occurs twice, its rows are one group each time their texts are
    equal and all rows with the smallest key are kept.  Null keys sort before all others.  An empty table gives an empty result, and other columns
    are ignored.  A group of any size is reduced before it is shuffled.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    size = F.octet_length("text")
    prints = source.where(size <= HUGE).mapInArrow(_prints("k"), f"k {kind}, fp long, n_bytes long, text_sha256 string")
    prints = common.cut(prints.unionAll(_huge_prints(source.where(size > HUGE), kind)))
    shared = common.cut(prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("m")).where("m > 1"))
    members = common.cut(common.dealt_join(prints, shared, ["fp", "n_bytes"], "k", shared).select(F.col("k").alias("m"), "fp", "n_bytes"))
    ids = members.groupBy("m", "fp", "n_bytes").agg(F.count("*").alias("_n")).drop("_n")
    compared = source.join(common.maybe_broadcast(ids), F.col("k").eqNullSafe(F.col("m"))).select("fp", "n_bytes", "text").mapInArrow(
        _chunks, "fp long, n_bytes long, chunk_no int, chunk binary"
    )
    differing = common.cut(
        compared.groupBy("fp", "n_bytes", "chunk_no").agg(F.min("chunk").alias("a"), F.max("chunk").alias("z")).where("a <> z").select("fp", "n_bytes").distinct()
    )
    split = prints.withColumn("part", F.lit(""))
    if not differing.isEmpty():
        split = prints.join(common.maybe_broadcast(differing).withColumn("d", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("part", F.when(F.col("d"), F.col("text_sha256")).otherwise("")).drop("d")
    groups = split.groupBy("fp", "n_bytes", "part").agg(F.min(F.struct(F.col("k"))).alias("lead"), F.count("*").alias("m"))
    groups = common.cut(groups)
    return common.dealt_join(split, groups, ["fp", "n_bytes", "part"], "k", groups).select(
        F.col("k").alias(key), F.col("lead.k").alias("keep_id"), F.col("m").alias("group_size"), F.col("k").eqNullSafe(F.col("lead.k")).alias("kept"), "text_sha256"
    )
