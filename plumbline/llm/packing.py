"""Bounded-space online best-fit packing of token pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_in, column_batches, trimmed, unsend
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins of ``capacity``.

    Open bins are kept by their free space, and a bitset (one integer, bit f set while some bin has f free) finds the
    least free space that holds an item as the lowest set bit from the item's size on. When a new bin is needed and
    all are open, the fullest (the lowest set bit) closes first. A bin without space closes at once.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: dict[int, list[int]] = {}
        self.bits, self.count, self.made = 0, 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """Place an item; returns its bin and its offset there."""
        if not 0 < size <= self.capacity:
            raise ValueError(size)
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - size
        if rest:
            self.by_free.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.count += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number


def cut_lengths(n: int, capacity: int) -> list[int]:
    """A document's pieces: all but the first take a whole bin."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def in_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same pieces in groups of exactly ``rows`` (the last may have fewer), each from long to short."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).sort_by(ORDER)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).sort_by(ORDER)


def pack(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    open_bins: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` ids; one row per piece, with its ids if asked for.

    Null texts count as empty (the end id alone). Rows without an id and rows that share one are documents of their
    own. Other columns are ignored; an empty table gives no rows. Pieces are dealt evenly by a hash of their length
    and document, ordered within a task by another, and packed in groups of ``open_bins`` pieces, each from long to
    short. A group fills no more bins than can be open, so the long pieces' bins stay open until the group's short
    pieces come, however many a task has; bins that are still open take pieces of later groups. The result doesn't
    depend on the order of arrival. ``sequence_id`` is the task's number and the bin's. Very long texts are encoded
    whole and cut into as many pieces as they need; ``batch_bytes`` of text are encoded at a time, or one text.
    """
    unsend()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES + (", ids binary" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in column_batches(batches, batch_bytes):
            out: list[list] = [[], [], [], [], [], []]
            every, ends = enc.encode_column(batch.column("text"), end_id)
            for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                at = 0
                for piece, length in enumerate(cut_lengths(last - first, capacity)):
                    part = every[first + at : first + at + length].tobytes()
                    for column, value in zip(out, (doc_id, piece, at, length, zlib.crc32(part), part)):
                        column.append(value)
                    at += length
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            n = 6 if with_ids else 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds)], names[:n])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for group in in_groups(batches, open_bins):
            put = np.array([bins.put(x) for x in group.column("length").to_pylist()], dtype=np.int64)
            group = group.append_column("sequence_id", pa.array(put[:, 0] + base, pa.int64())).append_column("offset", pa.array(put[:, 1], pa.int64()))
            yield from group.to_batches()

    pieces = rows.mapInArrow(trimmed(encode), schema)
    size = bytes_in(df)  # a task's last bins stay open, so there are no more tasks than the input gives work to
    tasks = max(1, min(size // (4 << 20), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), size // (512 << 20))
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", "length"))
    ordered = dealt.sortWithinPartitions(F.xxhash64("ids_crc32", "piece", "doc_id", "length"), "doc_id", "piece", "ids_crc32", "length")
    return ordered.mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids as one binary of unsigned 32-bit integers each, from :func:`pack` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
