"""Best-fit packing of token sequences by hierarchical residual merging.

Pieces are spread over partitions of bounded size.  Each partition packs its own pieces best-fit, longest first, emits
bins that are nearly full, and hands on the underfull ones as single items; those are packed again in as many partitions
as they need, round by round, until one partition of bounded size holds them or a round merges nothing.  Where a piece
lies follows from its place in its first bin and that bin's place in each later one.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a sequence, the id after each document, and the items of a packing task.
SEQUENCE, END_ID, TASK_ITEMS = 2048, 0, 200_000
#: A bin with at most so many free places goes out as it is.
SLACK = 4
#: Rounds at most; their numbers are the upper bits of a bin's.
MAX_ROUNDS = 30
#: A text with so many characters of white space in a row goes through the tokenizer itself: the rank file's encoder fails on much longer runs.
LONG_GAP = 1 << 12


def _rare() -> re.Pattern:
    """Characters that libraries of different Unicode versions may class differently.

    Those beyond the basic plane, and those that Unicode 3.2, which all know, did not have or classed otherwise.
    """
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    codes = [n for n in range(0x80, 0x10000) if not 0xD800 <= n < 0xE000 and old(chr(n))[0] != new(chr(n))[0] or old(chr(n)) == "Cn"]
    first = [n for k, n in enumerate(codes) if not k or codes[k - 1] != n - 1]
    last = [n for k, n in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != n + 1]
    spans = "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in zip(first, last, strict=True))
    return re.compile(f"[{spans}\\U00010000-\\U0010ffff]")
_SPECIAL = "<|endoftext|>"

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(path: str, ranks: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE in ``path`` (whose vocabulary, as ranks, is in ``ranks``).

    The special token's string stands for its id, as in ``path``.  A text with characters that may be classed otherwise there
    (see ``_rare``), or with a run of white space of LONG_GAP, goes through the tokenizer of ``path`` as a whole.
    """
    if path not in _ENCODERS:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb").read().splitlines())}  # noqa: SIM115
        special = len(merges)
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        rare, gap, whole = _rare(), re.compile(rf"\s{{{LONG_GAP}}}"), []

        def ids(text: str) -> np.ndarray:
            if rare.search(text) or len(text) >= LONG_GAP and gap.search(text):
                if not whole:
                    whole.append(Tokenizer.from_file(path))
                return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)
            first, *others = text.split(_SPECIAL)
            out = encode(first)
            for part in others:
                out.append(special)
                out += encode(part)
            return np.array(out, np.uint32)

        _ENCODERS[path] = ids
    return _ENCODERS[path]


def pieces_of(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: all of ``size`` but, for longer documents, a shorter first one."""
    head = length if length <= size else length % size or size
    return [(0, head), *((at, size) for at in range(head, length, size))]


def _tokenise(path: str, ranks: str, pattern: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern)
        for batch in batches:
            rows = [[], [], [], [], []]
            for key, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id))
                for n, (start, length) in enumerate(pieces_of(len(ids), size)):
                    for column, value in zip(rows, (key, n, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())), strict=True):
                        column.append(value)
            kinds = (batch.column("k").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names=["k", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of items given longest first: each one's bin and offset, and the bins' fills.

    Bins are kept by free space; the fullest that still has room is found in a bit set of the spaces in use.
    """
    n = len(lengths)
    bins, offsets, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    used = 0  # bit s: a bin with s free places exists
    for i, length in enumerate(lengths.tolist()):
        fit = used >> length
        if fit:
            space = length + ((fit & -fit).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                used &= ~(1 << space)
        else:
            b, space = len(fills), size
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += length
        left = space - length
        if left:
            free[left].append(b)
            used |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


_PACKED = "bin long, offset long, fill long"


def _pack(stage: int, size: int, keys: list[str]):
    """Packs a partition's items; bins are numbered by round, partition and order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held or not any(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([("length", "descending"), *((k, "ascending") for k in keys)])
        bins, offsets, fills = best_fit(table["length"].to_numpy(), size)
        base = (stage << 58) | (TaskContext.get().partitionId() << 32)
        table = table.append_column("bin", pa.array(bins + base)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fills[bins]))
        yield from table.to_batches(max_chunksize=100_000)
    return run


def pack(items: DataFrame, keys: list[str], size: int = SEQUENCE, slack: int = SLACK, task_items: int = TASK_ITEMS) -> DataFrame:
    """``items`` (``keys``, ``length`` of 1 to ``size`` and others) with sequence_id and a gapless offset.

    Each round deals what is left to as many tasks as ``task_items`` asks for.  After one that merged nothing, only the bins
    that are at most half full, one of a task, meet again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys, "length").schema)
    count = items.count()
    parts = max(1, -(-count // task_items))
    spread = items.select(*keys, "length")
    spread = spread.repartition(parts, *keys) if parts > 1 else spread.coalesce(1)
    first = placed = common.cut(spread.mapInArrow(_pack(0, size, keys), f"{schema}, {_PACKED}"))
    maps, stage, before = [], 0, None
    while True:
        open_bins = placed.where(F.col("fill") < size - slack).groupBy("bin").agg(F.max("fill").alias("length")).withColumnRenamed("bin", "item")
        open_bins = common.cut(open_bins)
        left = open_bins.count()
        if left == before:
            open_bins = common.cut(open_bins.where(2 * F.col("length") <= size))
            left = open_bins.count()
        if left < 2 or parts == 1 or stage == MAX_ROUNDS:
            break
        stage, before = stage + 1, left
        parts = -(-left // task_items)
        spread = open_bins.repartition(parts, "item") if parts > 1 else open_bins.coalesce(1)
        placed = common.cut(spread.mapInArrow(_pack(stage, size, ["item"]), f"item long, length long, {_PACKED}"))
        maps.append(placed.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by")))

    def follow(df: DataFrame, step: DataFrame) -> DataFrame:
        """Bins that a later round has taken in give way to its bins."""
        joined = df.join(common.maybe_broadcast(step), "bin", "left")
        return joined.select(*keys, "length", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))

    return reduce(follow, maps, first.select(*keys, "length", "bin", "offset")).withColumnRenamed("bin", "sequence_id").drop("length")


def best_fit_packing(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID, task_items: int = TASK_ITEMS
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end_id``; null texts count as empty, so they are one piece of one id.  Only documents
    longer than ``size`` are cut, and only their first piece may be shorter.  Rows with equal keys are separate documents.
    An empty table gives an empty result; other columns are ignored.
    """
    common.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = source.mapInArrow(_tokenise(tokenizer, ranks, pattern, size, end_id), f"k {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = common.cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    placed = pack(pieces, ["row"], size, task_items=task_items)
    return pieces.join(placed, "row").select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
