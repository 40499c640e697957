"""What several operators share: sessions, keyed lookups of checked size, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many rows of a side, and bytes of it, are broadcast; beyond either, a shuffled join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes that a value of fixed size and the rest of a row take at most in a broadcast table.
_ROW_BYTES = 32
#: Rows of one key that go to one task in a dealt join.
HOT_ROWS = 1024
#: Rows of a checkpoint's file where their number is known, and files of a table of hot keys.
FILE_ROWS, HOT_FILES = 50_000, 2
#: Bytes of text handled at once by the numpy kernels; a longer document is handled alone.
BLOCK_BYTES = 2 << 20

_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
U64 = np.uint64
#: Stands for a null key: before all others.
NULL_KEY = -(1 << 63)


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches (long texts stay within a worker's memory) and a checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used; where none is set, a local session (as in tests) gets one of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    context = spark.sparkContext
    if not getattr(context, "_lodestone_shipped", False):
        context.addPyFile(_package())
        context._lodestone_shipped = True
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return spark


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written for a while."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _package() -> str:
    """A zip file of this library, for executors whose path does not hold it."""
    root = Path(__file__).resolve().parents[2]
    name = str(Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip")
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted((root / "lodestone").rglob("*.py")):
            out.write(path, path.relative_to(root))
    return name


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that no later loss recomputes them.

    A checkpoint has a file for each partition, also for empty ones, and on a local file system each file starts two processes.  Where
    it is known that there are at most ``rows`` (narrow ones), as many tasks compute and write them as that asks for, if fewer.
    """
    prepare(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes, counted here, are few; ``df`` as it is otherwise.  ``df`` should be a checkpoint."""
    sizes = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = all(isinstance(f.dataType, (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for f in df.schema)
    if not fixed:
        return df
    width = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(8 * len(df.columns) + _ROW_BYTES))
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= rows and got.b <= BROADCAST_BYTES else df


def dealt_join(many: DataFrame, one: DataFrame, on: list[str], by: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key ``on``; ``counts`` says in m how many rows of ``many`` have it.

    Rows of a key of more than HOT_ROWS are dealt over several tasks by the hash of column ``by``; the key's row of ``one``
    goes to each of them.  There is at most one such key for each HOT_ROWS rows of ``many``.
    """
    hot = counts.where(F.col("m") > HOT_ROWS).select(*on, F.ceil(F.col("m") / HOT_ROWS).cast("int").alias("_parts"))
    hot = cut(hot.repartition(HOT_FILES))
    if hot.isEmpty():
        return many.join(one, on, how)
    hot = maybe_broadcast(hot)
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))
    dealt = many.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    ones = one.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(ones, [*on, "_part"], how).drop("_part")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` alone, null texts as empty ones."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its items within them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of items of about ``limit`` bytes: first, last + 1, their bytes, their offsets."""
    data, at = buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int = _MULT) -> None:
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, BLOCK_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` reads any span's hash from them."""
    n = len(values)
    up, _ = powers.to(n)
    out = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Position-free hashes of the spans ``start:end``, which also depend on their lengths."""
    _, down = powers.to(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, and all of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_spans(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``gap``, and how many words precede each item (and in all)."""
    inside = ~gap[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    now = np.zeros(n + 1, bool)
    now[:n] = inside
    starts = np.flatnonzero(now & (~before | first))
    ends = np.flatnonzero(before & (~now | first))
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return span_hash(prefix_hash(data), starts, ends)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``starts:ends`` of ``data`` with one space after each, and where they start and end there."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int(at[-1] + sizes[-1]) + 1 if len(at) else 0, 0x20, np.uint8)
    if len(at):
        shift = np.repeat(at - starts, sizes)
        inside = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        out[inside + shift] = data[inside]
    return out, at, at + sizes


#: Ranges longer than this are compared by the interpreter's own comparison of bytes.
_LONG_RANGE = 1 << 10


def equal_ranges(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """For each pair of ranges of ``size`` bytes, at ``one`` in ``data`` and ``two`` in ``other``, whether their bytes are equal."""
    other = data if other is None else other
    out = np.ones(len(one), bool)
    long = np.flatnonzero(size > _LONG_RANGE)
    for k in long.tolist():
        out[k] = data[one[k] : one[k] + size[k]].tobytes() == other[two[k] : two[k] + size[k]].tobytes()
    live = np.flatnonzero((size > 0) & (size <= _LONG_RANGE))
    if not len(live):
        return out
    a, b = (np.concatenate([x, np.zeros(8, np.uint8)]) for x in (data, other))
    x, y = (np.ndarray((len(v) - 7,), "<u8", v, 0, (1,)) for v in (a, b))  # the eight bytes from each position
    at = 0
    while len(live):
        left = size[live] - at
        differ = x[one[live] + at] ^ y[two[live] + at]
        short = left < 8
        differ[short] &= (U64(1) << (left[short].astype(U64) << U64(3))) - U64(1)
        out[live[differ != 0]] = False
        live = live[(differ == 0) & (left > 8)]
        at += 8
    return out


def keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``docs`` as k (the key as it is), d (a long in the order of the keys, null first) and text (null as empty); one row (d, text) for each d;
    and, unless d is the key itself (or NULL_KEY), the keys (d, k).

    d is one of a text alone: rows that share a key have one d if their texts are equal, and are put in the order of their texts'
    SHA-256 if not.  Where keys are integers that tell texts apart, d is the key itself.
    """
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        same = source.select("k", F.coalesce(F.col("k").cast("long"), F.lit(NULL_KEY)).alias("d"), "text")
        twice = cut(source.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("twice")))
        if twice.isEmpty():
            return same, same.select("d", "text"), None
        shared = source.join(maybe_broadcast(twice), F.col("k").eqNullSafe(F.col("twice"))).groupBy("k").agg(F.min(F.sha2("text", 256)).alias("a"), F.max(F.sha2("text", 256)).alias("z"))
        if shared.where("a <> z").isEmpty():
            return same, same.select("d", "text").dropDuplicates(["d"]), None
    marked = source.withColumn("s", F.sha2("text", 256))
    order = (F.col("k2").asc_nulls_first(), "s2")
    numbers = marked.select(F.col("k").alias("k2"), F.col("s").alias("s2")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = cut(numbers.withColumn("d", F.monotonically_increasing_id()))
    rows = marked.join(numbers, F.col("k").eqNullSafe(F.col("k2")) & (F.col("s") == F.col("s2"))).select("k", "d", "text")
    return rows, rows.select("d", "text").dropDuplicates(["d"]), numbers.select("d", F.col("k2").alias("k"))


def table(df: DataFrame) -> DataFrame:
    """The rows, written as a Parquet table in the shared checkpoint folder (smaller there than a checkpoint).

    The folder is the session's own checkpoint folder, which goes when the others in it do; shuffles that only led
    here are let go.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
