"""What several operators share: the shared folder, staged tables, skew-safe joins, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: the class [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
#: ASCII letters in lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's own.

    Only where neither is set in a session of local threads, as in tests, a temporary folder is made and set; on a
    cluster executors couldn't see it, so that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        root = current.get()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the interpreter ends or by :func:`release`."""
    path = f"{shared_root(spark)}/plumbline-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written() -> int:
    """How many paths this process has written to the shared folder and not removed."""
    return len(_written)


def release(since: int = 0, but_last: int = 0) -> None:
    """Remove the tables and files that this process wrote to the shared folder, from number ``since`` on, but the last few."""
    until = len(_written) - but_last
    gone, _written[since:until] = _written[since:until], []
    for spark, path in gone:
        jvm = spark.sparkContext._jvm
        if jvm is None:
            continue
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may have gone first
        _written.clear()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark removes it with the last reference."""
    shared_root(df.sparkSession)
    return df.checkpoint()


_kept: dict = {}


def kept(name, make: Callable):
    """What an operator keeps in a worker process from task to task; another operator's takes its place."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def trim() -> None:
    """Give unused memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if back:
        back(0)


def forget() -> None:
    """Drop what an operator before this one has kept in a worker process, and unused memory."""
    _kept.clear()
    trim()


def trimmed(fn: Callable) -> Callable:
    """A function for ``mapInArrow`` after whose last batch the worker process gives unused memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return run


_sent: list = []


def send(spark: SparkSession, value):
    """Broadcast ``value``, of a size that the caller has bounded; :func:`unsend` takes it from the executors."""
    held = spark.sparkContext.broadcast(value)
    _sent.append(held)
    return held


def unsend() -> None:
    """Remove all values sent so far from the executors' memory; a task that still needs one fetches it again."""
    for held in _sent:
        if held._jbroadcast is not None:
            held.unpersist()
    _sent.clear()


def column_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` at most, whatever Arrow's batch size is."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, int(batch.num_rows * max_bytes / batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def crc_mod(doc_id, by: int) -> int:
    """crc32 of an id's decimal text, modulo ``by``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % by


def crc_mod_column(column: str, by: int):
    """The same as a column expression."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def bytes_in(df: DataFrame) -> int:
    """Bytes of the tables' files that ``df`` reads; what doesn't come from files counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.length())]
    return sum(int(str(x.stats().sizeInBytes())) for x in found if x.getClass().getSimpleName() == "LogicalRelation")


def partitions(df: DataFrame, each: int = 64 << 20, most: int = 2_000_000) -> int:
    """Partitions for a shuffle that is dealt by an explicit number, from the size of the input ``df``.

    One for ``each`` bytes of its files, but no fewer than the session's setting and cores.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, min(bytes_in(df) // each + 1, most))


def skew_safe_join(facts: DataFrame, groups: DataFrame, key: str | list[str], weight: str, total: int, share: int = 10_000) -> DataFrame:
    """``facts`` left joined with one row per ``key`` (longs) of ``groups``; ``weight``: its number of facts.

    Keys that hold more than 1/``share`` of ``total`` facts number at most ``share``, so these groups are broadcast
    whatever the input's size. Their facts take a hash of their own columns for a key in the shuffle join of all
    others, which spreads them evenly.
    """
    keys = [key] if isinstance(key, str) else key
    least, names = max(1000, total // share), [c for c in groups.columns if c not in keys]
    shown = lambda part, name: part.select(*[F.col(k).alias(f"_{name}{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_{name}_{c}") for c in names])
    same = lambda name, own: [F.col(x) == F.col(f"_{name}{i}") for i, x in enumerate(own)]
    every = lambda conditions: reduce(Column.__and__, conditions)
    hot, cold = shown(groups.filter(F.col(weight) > least), "hot"), shown(groups.filter(F.col(weight) <= least), "cold")
    marked = facts.join(F.broadcast(hot), every(same("hot", keys)), "left")
    dealt = marked.withColumn("_key", F.when(F.col("_hot0").isNull() & F.col(keys[0]).isNotNull(), F.col(keys[0])).otherwise(F.xxhash64(*facts.columns)))
    both = dealt.join(cold, every(same("cold", ["_key", *keys[1:]])), "left")
    found = F.col("_cold0") == F.col(keys[0])
    value = lambda c: F.when(F.col("_hot0").isNotNull(), F.col(f"_hot_{c}")).when(found, F.col(f"_cold_{c}"))
    return both.select(*facts.columns, *[value(c).alias(c) for c in names])


MULT = np.uint64(0x9E3779B97F4A7C15)


def bitmap(rows: DataFrame, size: int, places: Callable[[pa.RecordBatch], np.ndarray] = lambda batch: batch.column(0).to_numpy()) -> np.ndarray:
    """A bitmap of ``size`` bits, in 64-bit words, in which the places are set that ``places`` makes of each batch.

    Tasks hand on words and not places, so ``size`` / 64 rows reach the driver at most. Places are made in the same
    function as words: a second one behind it would start a second Python worker for each task, and workers stay.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch))
            words, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else at.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits).view(pa.int64())], ["word", "bits"])

    got = rows.mapInArrow(partial, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    marks = np.zeros(size // 64, dtype=np.uint64)
    marks[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return marks


def is_set(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _mark_places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * MULT
    return [((x >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64) for shift in (36, 8)]


def id_marks(ids: DataFrame, column: str = "doc_id", most: int = 1 << 27) -> np.ndarray:
    """A bitmap in which two hashed places of each id are set, gathered without nulls.

    It has about 16 bits for each id and ``most`` at most (16 MB): with more than some ten million ids it lets more
    and more others through, which whoever uses it has to join away as well.
    """
    known = ids.select(F.col(column).cast("long").alias("id")).filter("id is not null")
    size = min(most, max(1 << 16, 1 << (16 * known.count()).bit_length()))
    return bitmap(known, size, lambda batch: np.concatenate(_mark_places(batch.column(0).to_numpy(), size)))


def marked(ids: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Which ids may be among those that were marked; a null isn't."""
    fit = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    for at in _mark_places(pc.fill_null(ids, 0).to_numpy(), 64 * len(marks)):
        fit &= is_set(marks, at)
    return fit


def without_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df``, with all columns, whose id isn't in ``ids``; rows without an id stay.

    Hashed marks of the ids let most rows stay where they are; only those that match go through a join. The ids are
    written once, as both need them.
    """
    ids = cut(ids.select(id_col))
    held = send(df.sparkSession, id_marks(ids, id_col))
    place = df.columns.index(id_col)

    def part(wanted: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marked(batch.column(place).cast(pa.int64()), held.value) == wanted))

        return df.mapInArrow(rows, df.schema)

    gone = ids.select(F.col(id_col).alias("_gone")).filter("_gone is not null").distinct()
    return part(False).unionByName(part(True).join(gone, F.col(id_col) == F.col("_gone"), "left_anti"))


def rows_where(df: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of ``df``, with all columns, for whose texts ``keep`` says so; null counts as empty."""
    place = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_batches(batches):
            texts = [x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return df.mapInArrow(trimmed(rows), df.schema)
