"""Token ids as binary segments: one concatenated id array with Elias-Fano coded document boundaries.

A segment holds consecutive documents in ascending id order. Its payload is

    magic "PLEF", version, id width in bytes, bits of a low part, 0    4 + 4 bytes
    documents n, ids u, bytes of the low parts, of the high bits       4 x 8 bytes, little endian
    low parts (n values of l bits), high bits (unary)                  padded to bytes
    ones before each block of 64 bytes of the high bits                4 bytes each, little endian
    ids

The n end positions e_0 <= ... <= e_{n-1} = u are split at l = max(0, floor(log2(u / n))) bits: the low parts are
stored as they are, and bit (e_i >> l) + i of the high bits is set. That takes at most n * (2 + log2(u / n)) bits.
The stored counts, one for 512 bits, are the select structure: ``Segment.select`` finds the i-th one's block among
them, its byte by the block's byte counts and its bit by a table, so there is no table of 64-bit offsets.

Segments are rows of a Parquet table in the shared folder, so they are committed by Spark's writer on any store;
``export`` writes each payload as a raw file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_batches, partitions, shared_path
from .tokens import encoder

MAGIC, VERSION, HEAD = b"PLEF", 2, struct.Struct("<4sBBBxQQQQ")
#: Ones in each byte value.
ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)
#: The place of each byte value's k-th one, as far as it has one.
PLACES = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[:8] for x in range(256)], dtype=np.int64)
#: Bytes of high bits that have one stored count, and ends that are looked up at a time.
BLOCK, AT_ONCE = 64, 1 << 14
DOCS = "shard int, seq int, before bigint, doc_ids array<bigint>, n_tokens bigint, payload binary"


def pack_ends(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano code of ascending values: bits of a low part, low parts, high bits."""
    n = len(ends)
    top = int(ends[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    values = ends.astype(np.uint64)
    low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = np.zeros((top >> low_bits) + n + 1 if n else 0, dtype=np.uint8)
    high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    return low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def pack_counts(high: bytes) -> np.ndarray:
    """Ones before each block of the high bits."""
    ones = ONES[np.frombuffer(high, np.uint8)]
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK)) if len(ones) else ones
    return np.cumsum(blocks) - blocks


def build_segment(docs: list[np.ndarray]) -> bytes:
    """The payload for some documents' ids; ids take two bytes where all of them fit."""
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    ends = np.cumsum([len(x) for x in docs], dtype=np.int64) if docs else np.zeros(0, np.int64)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    low_bits, low, high = pack_ends(ends)
    head = HEAD.pack(MAGIC, VERSION, width, low_bits, len(docs), len(ids), len(low), len(high))
    return head + low + high + pack_counts(high).astype("<u4").tobytes() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """Reads a payload: ``select(i)`` is the end of document i, or of each of an array of them; ``ids(i)`` its ids."""

    def __init__(self, payload: bytes):
        magic, version, self.width, self.low_bits, self.n, self.size, n_low, n_high = HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment")
        at, blocks = HEAD.size, -(-n_high // BLOCK)
        self.low = np.frombuffer(payload, np.uint8, n_low, at)
        self.high = np.frombuffer(payload, np.uint8, n_high, at + n_low)
        self.before = np.frombuffer(payload, "<u4", blocks, at + n_low + n_high)
        self.data = np.frombuffer(payload, f"<u{self.width}", self.size, at + n_low + n_high + 4 * blocks)

    def select(self, i):
        wanted = np.atleast_1d(np.asarray(i, dtype=np.int64))
        if len(wanted) and not (0 <= wanted.min() and wanted.max() < self.n):
            raise IndexError(i)
        parts = [self._select(wanted[at : at + AT_ONCE]) for at in range(0, len(wanted), AT_ONCE)]
        found = np.concatenate(parts) if parts else wanted
        return found if np.ndim(i) else int(found[0])

    def _select(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, i, side="right") - 1
        rest = i - self.before[block]
        # the byte in which the block's ones exceed what is left, then the bit in it
        byte = BLOCK * block[:, None] + np.arange(BLOCK)
        upto = np.cumsum(np.where(byte < len(self.high), ONES[self.high[np.minimum(byte, len(self.high) - 1)]], 0), axis=1)
        k = (upto <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(k > 0, upto[np.arange(len(i)), np.maximum(k - 1, 0)], 0)
        at = BLOCK * block + k
        value = 8 * at + PLACES[self.high[at], rest] - i
        for bit in range(self.low_bits - 1, -1, -1):
            place = i * self.low_bits + bit
            value = value << 1 | (self.low[place >> 3] >> (place & 7) & 1)
        return value

    def ids(self, i: int) -> np.ndarray:
        return self.data[self.select(i - 1) if i else 0 : self.select(i)]


def write_tokens(
    df: DataFrame,
    tokenizer_path: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    segment_tokens: int = 1 << 20,
) -> None:
    """Encode every whole text and write segments in ascending order of ``id_col`` to ``path``.

    Null texts count as empty and so have the end id alone. Rows without an id come first; rows that share an id
    follow each other by their content's crc32 and length. Other columns are ignored, an empty table gives no segment.
    The order comes from quantiles of the ids alone: each row is dealt to its range before it is encoded, so the
    texts are shuffled once and tokens never are; a range is sorted and cut into segments by its own task.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = partitions(df) * 2
    steps = [i / shards for i in range(1, shards)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, 100 * shards).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # the number of cuts below the id, found by halves
    place = F.lit(0) if not cuts else F.when(F.col("doc_id").isNull(), 0).otherwise(_rank(F.col("doc_id"), cuts))
    dealt = rows.withColumn("shard", place.cast("int")).repartitionById(len(cuts) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit(""))), F.length("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, docs, ids, size, seq, before = encoder(tokenizer_path), [], [], 0, 0, 0
        shard = TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            cols = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([size], pa.int64()), pa.array([build_segment(docs)], pa.binary())], ["shard", "seq", "before", "doc_ids", "n_tokens", "payload"])

        for batch in column_batches(batches, 8 << 20):
            got, ends = enc.encode_column(batch.column("text"), end_id)
            got = got.astype("<u2") if len(got) and int(got.max()) < 1 << 16 else got
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                docs.append(got[a:b])
                ids.append(doc_id)
                size += b - a
                if size >= segment_tokens:
                    yield close()
                    docs, ids, size, seq, before = [], [], 0, seq + 1, before + size
        if docs:
            yield close()

    ordered.mapInArrow(encode, DOCS).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def _rank(column, cuts: list):
    """How many of the sorted ``cuts`` are not above the column, as a balanced tree of comparisons."""

    def node(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts))


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    start counts the ids of all documents before it: a segment holds the count within its shard, and shards' totals
    are summed up, one row for each task of the writing job.
    """
    segments = spark.read.schema(DOCS).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.column("payload")[i].as_py())
                ends = segment.select(np.arange(segment.n))
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                wide = segment.data.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)]
                first = batch.column("first")[i].as_py()
                cols = [pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), pa.array(starts + first, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([wide[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    based = segments.join(F.broadcast(base), "shard").select("doc_ids", "payload", (F.col("base") + F.col("before")).alias("first"))
    return based.mapInArrow(decode, schema)


def export(spark, path: str, to: str) -> DataFrame:
    """Write each payload of ``path`` as a raw file ``to``/shard-seq.seg through pyarrow's file systems; returns the names."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            names = []
            for row in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(to)
                store.create_dir(base, recursive=True)
                names.append(f"{row['shard']:06d}-{row['seq']:06d}.seg")
                with store.open_output_stream(f"{base}/{names[-1]}") as out:
                    out.write(row["payload"])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return spark.read.schema(DOCS).parquet(path).select("shard", "seq", "payload").mapInArrow(save, "file string")


def encoded(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared one and read it back."""
    path = shared_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer_path, path, **options)
    return read_tokens(df.sparkSession, path)
