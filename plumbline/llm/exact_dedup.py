"""Exact deduplication by Grace hash partitioning with complete comparison of the contents."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bytes_of, column_batches, forget, partitions, staged, trimmed, unsend

#: Contents of a task that are held in memory at once; what is beyond goes to spill files.
MEMORY = 48 << 20
FANOUT = 16


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


class Table:
    """Open addressing with linear probing; a slot matches only if the complete contents are equal."""

    def __init__(self):
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []

    def find(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """The entry of a content, and whether it is new."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = len(self.digests)
        self.digests.append(digest)
        self.contents.append(content)
        if len(self.digests) * 2 > len(self.slots):
            self._grow()
        return len(self.digests) - 1, True

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 4, -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def grace(records: Iterator[tuple], level: int = 0, memory: int = MEMORY, fold: Callable | None = None) -> Iterator[tuple]:
    """Groups of equal contents from records (digest, content, item): (digest, items).

    With ``fold`` a group has one item, to which ``fold(kept, next)`` reduces them as they come; so a content that
    comes very often takes no more room than any other. Without it, items are gathered and should be small.

    Records go into one table while their distinct contents fit in ``memory``. From then on those whose content the
    table has still join it, and the others are dealt by the next digit of their digest to ``FANOUT`` spill files,
    each of which is done the same way. The files are nameless and vanish with the task. A digest has 64 digits; if
    they run out (equal digests of different contents), the rest is done in memory.
    """
    table, items, size, spills, known = Table(), [], 0, None, set()
    for digest, content, item in records:
        if spills is None or level >= 64 or digest in known:
            entry, new = table.find(digest, content)
            if new:
                items.append(item if fold else [item])
                size += len(content)
            elif fold:
                items[entry] = fold(items[entry], item)
            else:
                items[entry].append(item)
            if size > memory and spills is None and level < 64:
                spills, known = [tempfile.TemporaryFile() for _ in range(FANOUT)], set(table.digests)
            continue
        digit = digest[level >> 1] >> (4 * (level & 1)) & 15
        pickle.dump((digest, content, item), spills[digit], protocol=5)
    for entry, gathered in enumerate(items):
        yield table.digests[entry], gathered
    del table, items
    for f in spills or ():
        f.seek(0)
        with f:
            yield from grace(_spilled(f), level + 1, memory, fold)


def _spilled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


ENTRIES = "entry bigint, digest binary, text string, best struct<n:bigint,id:bigint,entry:bigint,at:int>, count bigint, members array<struct<id:bigint,n:bigint>>"
BEST = pa.struct([("n", pa.int64()), ("id", pa.int64()), ("entry", pa.int64()), ("at", pa.int32())])
MEMBER = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def better(a: tuple) -> tuple:
    """Sort key of (n, id, entry, at): most code points, then smallest id (none last), then first come."""
    n, doc_id, entry, at = a
    return (-n, doc_id is None, doc_id or 0, entry, at)


def _local(batches: Iterator[pa.RecordBatch], run_bytes: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """Equal contents of a run of rows become one entry, so a hot content leaves a task a few times at most."""
    base, made = TaskContext.get().partitionId() << 32, 0

    def close(entries: dict) -> pa.RecordBatch:
        rows = list(entries.values())
        best = [dict(zip(("n", "id", "entry", "at"), x["best"])) for x in rows]
        members = [[{"id": i, "n": n} for i, n in x["members"]] for x in rows]
        cols = [pa.array([x["entry"] for x in rows], pa.int64()), pa.array([x["digest"] for x in rows], pa.binary()), pa.array([x["text"] for x in rows], pa.binary()).cast(pa.string())]
        cols += [pa.array(best, BEST), pa.array([len(x["members"]) for x in rows], pa.int64()), pa.array(members, MEMBER)]
        return pa.RecordBatch.from_arrays(cols, ["entry", "digest", "text", "best", "count", "members"])

    table, entries, size = Table(), {}, 0
    for batch in column_batches(batches):
        raw = bytes_of(batch)
        for doc_id, text, n in zip(batch.column("doc_id").to_pylist(), raw, batch.column("n").to_pylist()):
            content = normalised(text)
            at, new = table.find(hashlib.sha256(content).digest(), content)
            if new:
                entries[at] = {"entry": base + made, "digest": table.digests[at], "text": text, "members": [], "best": None}
                made += 1
                size += len(text)
            x = entries[at]
            own = (n, doc_id, x["entry"], len(x["members"]))
            x["members"].append((doc_id, n))
            if x["best"] is None or better(own) < better(x["best"]):
                x["best"] = own
            size += 64
            if size > run_bytes:
                yield close(entries)
                table, entries, size = Table(), {}, 0
    if entries:
        yield close(entries)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per entry: its group's kept row, size and digest."""

    def records() -> Iterator[tuple]:
        for batch in column_batches(batches):
            best = batch.column("best").to_pylist()
            for entry, digest, text, b, count in zip(batch.column("entry").to_pylist(), batch.column("digest").to_pylist(), bytes_of(batch), best, batch.column("count").to_pylist()):
                yield digest, normalised(text), (entry, (b["n"], b["id"], b["entry"], b["at"]), count)

    out: list[tuple] = []
    for digest, items in grace(records()):
        keep = min((x[1] for x in items), key=better)
        total = sum(x[2] for x in items)
        out += [(x[0], keep[1], keep[2], keep[3], total, digest.hex()) for x in items]
        if len(out) > 20_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


GROUPS = "entry bigint, keep_id bigint, keep_entry bigint, keep_at int, group_size bigint, text_sha256 string"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["entry", "keep_id", "keep_entry", "keep_at", "group_size", "text_sha256"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]; null counts as empty. Of
    equal texts the row with the most code points stays, then the smallest id (rows without an id last), then one of
    the repeated rows, so exactly one row of a group is kept. Other columns are ignored; an empty table gives no rows.

    Each input task folds equal contents of a run of rows to an entry and writes it once; entries are dealt by their
    digest and grouped by :func:`grace`, so a content that a third of all rows share reaches its bucket only a few
    times for each input task. Rows find their group by the entry's number, of which none has more rows than a run.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    entries = staged(rows.mapInArrow(_local, ENTRIES), "entries")
    dealt = entries.select("entry", "digest", "text", "best", "count").repartition(partitions(df), F.col("digest"))
    groups = dealt.mapInArrow(_buckets, GROUPS)
    members = entries.select("entry", F.posexplode("members").alias("at", "member"))
    return members.join(groups, "entry").select(
        F.col("member.id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("entry") == F.col("keep_entry")) & (F.col("at") == F.col("keep_at"))).alias("kept"),
        "text_sha256",
    )


def _rows_local(batches: Iterator[pa.RecordBatch], run_bytes: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """The best row of each content of a run, with its digest and rank."""
    forget()
    base, made, table, best, size, kept = TaskContext.get().partitionId() << 32, 0, Table(), {}, 0, []

    def close() -> Iterator[pa.RecordBatch]:
        chosen = sorted((ref, at, rank) for at, (rank, ref) in best.items())
        by_batch: dict[int, list] = {}
        for (b, i), at, rank in chosen:
            by_batch.setdefault(b, []).append((i, table.digests[at], rank))
        for b, picked in by_batch.items():
            part = kept[b].take(pa.array([i for i, _, _ in picked], pa.int64()))
            cols = [*part.columns, pa.array([d for _, d, _ in picked], pa.binary()), pa.array([r[3] for _, _, r in picked], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, "digest", "entry"])

    for batch in column_batches(batches):
        kept.append(batch)
        ids, lengths = batch.column("_id").to_pylist(), batch.column("_n").to_pylist()
        for i, (doc_id, n, text) in enumerate(zip(ids, lengths, bytes_of(batch, "_text"))):
            content = normalised(text)
            at, _ = table.find(hashlib.sha256(content).digest(), content)
            rank = (-n, doc_id is None, doc_id or 0, base + made)
            made += 1
            if at not in best or rank < best[at][0]:
                best[at] = (rank, (len(kept) - 1, i))
        size += batch.nbytes
        if size > run_bytes:
            yield from close()
            table, best, size, kept = Table(), {}, 0, []
    yield from close()


def exact_keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_groups` keeps, with all their columns, in one shuffle.

    Columns of any name stay as they are; the kept rows are whole rows, so repeated rows leave one. Null and very long
    texts, ties and empty tables count as there.
    """
    unsend()
    names = df.columns
    packed = df.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col]).alias("row"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long").alias("_n"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema)
    local = packed.mapInArrow(trimmed(_rows_local), schema + ", digest binary, entry bigint")
    dealt = local.repartition(partitions(df), F.col("digest"))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows go through the table and its spill files; of equal contents the best so far is held."""
        form = None

        def records() -> Iterator[tuple]:
            nonlocal form
            for batch in column_batches(batches, 4 << 20):
                rest = batch.select(["row", "_text", "_id", "_n"])
                form = form or rest.schema
                for row, digest, entry, text in zip(rest.to_pylist(), batch.column("digest").to_pylist(), batch.column("entry").to_pylist(), bytes_of(batch, "_text")):
                    yield digest, normalised(text), ((-row["_n"], row["_id"] is None, row["_id"] or 0, entry), row)

        held, size = [], 0
        for _, (_, row) in grace(records(), memory=MEMORY // 2, fold=lambda a, b: min(a, b, key=lambda x: x[0])):
            held.append(row)
            size += len(row["_text"] or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, form)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, form)

    chosen = dealt.mapInArrow(trimmed(bucket), schema)
    kinds = dict(df.dtypes)
    return chosen.select(*[F.col("_text").cast(kinds[c]).alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
