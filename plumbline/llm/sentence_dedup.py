"""Substring deduplication: sentences covered by a repeated run of consecutive sentences are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_batches, cut, skew_safe_join, staged, texts_of, trimmed

#: A sentence: no mark or line end, then the marks that end it.
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
MULT = np.uint64(0x9E3779B97F4A7C15)
KEPT = ["doc_id", "n_sentences", "removed", "shared", "spans"]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence with single spaces) of all sentences that aren't blank."""
    found = ((m.start(), m.end(), BLANKS.sub(" ", m.group()).strip(" ")) for m in SENTENCE.finditer(text))
    return [x for x in found if x[2]]


def runs_of(parts: list[str], span: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sentence: two 64-bit hashes of its run, and the run's size, which is 0 where the text ends too early.

    A sentence's run are the consecutive sentences from it on until they are ``span`` at least and have
    ``least_words`` words, or the sentence alone if it has twice as many.
    """
    raw = b"".join(xxhash.xxh3_128_digest(x.encode()) for x in parts)
    h = np.frombuffer(raw, "<u8").reshape(-1, 2).astype(np.uint64)
    words = np.array([x.count(" ") + 1 for x in parts], dtype=np.int64)
    at, before = np.arange(len(h)), np.concatenate([[0], np.cumsum(words)])
    ends = np.maximum(np.searchsorted(before, before[:-1] + least_words), at + span)
    ends = np.where(words >= 2 * least_words, at + 1, ends)
    sizes = np.where(ends <= len(h), ends - at, 0)
    out = np.full((len(sizes), 2), least_words, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > i)
            out[on] = (out[on] ^ (out[on] >> np.uint64(31))) * MULT + h[on + i]
        out = (out ^ (out >> np.uint64(32))) * MULT + sizes[:, None].astype(np.uint64)
    out ^= out >> np.uint64(29)
    return out[:, 0], out[:, 1], sizes


ROWS = "row bigint, doc_id bigint, starts array<int>, ends array<int>, runs array<struct<a:bigint,b:bigint>>, sizes array<int>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *values]).astype(kind.to_pandas_dtype()), kind))


def _split(span: int, least_words: int, keep_text: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in column_batches(batches):
            starts, ends, firsts, seconds, sizes = [], [], [], [], []
            for text in texts_of(batch):
                found = sentences(text)
                starts.append(np.array([a for a, _, _ in found], dtype=np.int32))
                ends.append(np.array([b for _, b, _ in found], dtype=np.int32))
                for column, x in zip((firsts, seconds, sizes), runs_of([s for _, _, s in found], span, least_words)):
                    column.append(x.view(np.int64))
            a, b = _lists(firsts, pa.int64()), _lists(seconds, pa.int64())
            runs = pa.ListArray.from_arrays(a.offsets, pa.StructArray.from_arrays([a.values, b.values], ["a", "b"]))
            columns = [pa.array(range(made, made + batch.num_rows), pa.int64()), batch.column("doc_id"), _lists(starts, pa.int32()), _lists(ends, pa.int32()), runs, _lists(sizes, pa.int32())]
            made += batch.num_rows
            names = ["row", "doc_id", "starts", "ends", "runs", "sizes"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * keep_text, names + ["text"] * keep_text)

    return trimmed(split)


def _repeated(rows: DataFrame) -> DataFrame:
    """(row, later, others): numbers of a row's repeated runs that aren't the first one, and of those that other rows have.

    A run's first occurrence is the one with the least id (none last), row and place. Counts and first occurrences are
    summed up before the shuffle; runs that more than one in 10,000 occurrences are of are broadcast.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("at"))
    places = rows.select("row", "doc_id", "sizes", F.posexplode("runs").alias("at", "run")).filter(F.get("sizes", F.col("at")) > 0).select("row", "doc_id", "at", "run.*")
    groups = places.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("c"), F.min("row").alias("r0"), F.max("row").alias("r1")).filter("c > 1")
    groups = cut(groups.select("a", "b", F.col("first.row").alias("row0"), F.col("first.at").alias("at0"), "c", (F.col("r0") < F.col("r1")).alias("shared")))
    total = rows.agg(F.sum(F.size("runs"))).first()[0] or 0
    met = skew_safe_join(places.select("row", "at", "a", "b"), groups, ["a", "b"], "c", total).filter("row0 is not null")
    later = F.when(~((F.col("row") == F.col("row0")) & (F.col("at") == F.col("at0"))), F.col("at"))
    return met.groupBy("row").agg(F.collect_set(later).alias("later"), F.collect_set(F.when(F.col("shared"), F.col("at"))).alias("others"))


def repeated_sentences(df: DataFrame, span: int = 2, least_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_sentences, removed, shared (numbers from 0), spans (of removed, in code points).

    From every sentence on, the shortest run of consecutive sentences that are ``span`` at least and have
    ``least_words`` words (or the sentence alone, if it has twice as many) is compared with those of all rows by 128
    bits of a hash of the sentences with single spaces. Sentences in any but a run's first occurrence are removed;
    shared are those in runs that another row has too, the first one's included. Texts of fewer sentences or words have
    no runs. Null texts count as empty and have no sentences. Repeated rows, also with the same id, are rows of their
    own of which one is first. Rows without an id come last. Very long texts are one row like any other; columns beside
    the two are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _found(cut(rows.mapInArrow(_split(span, least_words, False), ROWS))).drop("row")


def _found(rows: DataFrame, *more: str) -> DataFrame:
    both = rows.drop("runs").join(_repeated(rows), "row", "left")

    def covered(ats: str):
        every = F.flatten(F.transform(F.coalesce(ats, F.array().cast("array<int>")), lambda x: F.sequence(x, x + F.get("sizes", x) - 1)))
        return F.array_sort(F.array_distinct(every))

    spans = F.transform("removed", lambda x: F.struct(F.get("starts", x).alias("start"), F.get("ends", x).alias("end")))
    shown = both.select("row", "doc_id", F.size("starts").cast("long").alias("n_sentences"), covered("later").alias("removed"), covered("others").alias("shared"), *more, "starts", "ends")
    return shown.select("row", "doc_id", "n_sentences", "removed", "shared", spans.alias("spans"), *more)


def without_repeats(df: DataFrame, span: int = 2, least_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`repeated_sentences` with the text that is left when the removed sentences are taken out."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _found(staged(rows.mapInArrow(_split(span, least_words, True), ROWS + ", text string"), "sentences"), "text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_batches(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                at, left = 0, []
                for x in spans:
                    left.append(text[at : x["start"]])
                    at = x["end"]
                out.append(None if text is None else "".join([*left, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in KEPT] + [pa.array(out, pa.string())], [*KEPT, "text"])

    return found.select(*KEPT, "text").mapInArrow(clean, "doc_id bigint, n_sentences bigint, removed array<int>, shared array<int>, spans array<struct<start:int,end:int>>, text string")
