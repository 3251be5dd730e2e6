"""Personal data and the terms that disclose it.

Patterns find protected entities. The corpus tells how strongly a term reveals one: with the rows that hold the
term, n(t), the entity, n(e), and the term near the entity, c(t, e), of N rows, the pointwise mutual information
log(c N / (n(t) n(e))) over the entity's information -log(n(e) / N) is 1 where a term never occurs without
the entity. Terms over one threshold are removed, those over a lower one generalised, wherever they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, column_batches, cut, send, texts_of, trimmed, unsend

# Base patterns; the order of the kinds is fixed.
KINDS = ("email", "ip", "card", "phone", "term", "hint")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
NOT_DIGITS = re.compile(r"[^0-9]+")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@domain, from each @ to the left: its run of characters begins the match."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCALS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m.group()) if m.end() - m.start() < 60 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in that order; kinds are searched one by one."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(a, 1, b) for a, b in ips(text)]
    found += [(a, 2, b) for a, b in cards(text)]
    if "+" in text:
        found += [(a, 3, b) for a, b in phones(text)]
    return sorted(found)


def contexts(text: str, found: list[tuple[int, int, int]], words: int, reach: int) -> Iterator[tuple[str, int, set[str]]]:
    """(entity, hash of its context, terms) for each mention: up to ``words`` words within ``reach`` characters on
    either side, without other mentions."""
    for start, kind, end in found:
        left, right = text[max(0, start - reach) : start], text[end : end + reach]
        for a, _, b in found:
            lo, hi = max(a - max(0, start - reach), 0), b - max(0, start - reach)
            if (a, b) != (start, end) and lo < len(left) and hi > 0:
                left = left[:lo] + " " * (min(hi, len(left)) - lo) + left[hi:]
            lo, hi = max(a - end, 0), b - end
            if (a, b) != (start, end) and lo < len(right) and hi > 0:
                right = right[:lo] + " " * (min(hi, len(right)) - lo) + right[hi:]
        before, after = WORD.findall(left.lower())[-words:], WORD.findall(right.lower())[:words]
        yield f"{KINDS[kind]}:{text[start:end].lower()}", xxhash.xxh3_64_intdigest(" ".join(before + ["|"] + after)) - (1 << 63), {*before, *after}


ROWS = "doc_id bigint, content bigint, base array<struct<start:int,kind:int,end:int>>, mentions array<struct<entity:string,context:bigint,terms:array<struct<term:string,fresh:int>>>>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
MENTION = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("fresh", pa.int32())])))]))
SLOTS = 1 << 26


def _content(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _once(found: Iterator[tuple[str, int, set[str]]]) -> list[dict]:
    """A text's mentions; a term is fresh (1) where it meets an entity for the first time in the text."""
    met, out = set(), []
    for entity, context, terms in found:
        out.append({"entity": entity, "context": context, "terms": [{"term": t, "fresh": int((entity, t) not in met)} for t in sorted(terms)]})
        met.update((entity, t) for t in terms)
    return out


def _scan(words: int, reach: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_batches(batches):
            base, mentions, keys = [], [], []
            for text in texts_of(batch):
                found = entities(text)
                keys.append(_content(text))
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                mentions.append(_once(contexts(text, found, words, reach)))
            columns = [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(base, SPAN), pa.array(mentions, MENTION)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "base", "mentions"])

    return scan


def _slot(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) & (SLOTS - 1)


def _marks(terms: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) in which each term's hashed place is set."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_slot(t) for t in batch.column("term").to_pylist()], pa.int64())], ["place"])

    return bitmap(terms.mapInArrow(slots, "place bigint"), SLOTS).view(np.uint8)


class _Marked:
    """The words of a batch's texts whose place is set, as (text, word) numbers."""

    def __init__(self, texts: pa.Array, bits: np.ndarray):
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        number: dict[str, int] = {}
        of_piece: list[list[int]] = []
        for piece in coded.dictionary.to_pylist():
            words = [w for w in WORD.findall(piece.lower()) if bits[(s := _slot(w)) >> 3] >> (s & 7) & 1]
            of_piece.append([number.setdefault(w, len(number)) for w in words])
        counts = np.fromiter(map(len, of_piece), dtype=np.int64, count=len(of_piece))
        every = np.array([w for ws in of_piece for w in ws], dtype=np.int64)
        first = np.cumsum(counts) - counts
        code = coded.indices.to_numpy()
        hit = np.flatnonzero(counts[code] > 0) if len(code) else np.zeros(0, dtype=np.int64)
        many = counts[code[hit]]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.word = every[np.repeat(first[code[hit]], many) + inner]
        self.text = np.repeat(np.searchsorted(split.offsets.to_numpy(), hit, side="right") - 1, many)
        self.words = list(number)


def _holding(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, nt): how many rows hold each term, summed up by each task before the shuffle."""
    held = send(rows.sparkSession, _marks(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

        for batch in column_batches(batches):
            found = _Marked(pc.fill_null(batch.column("text"), ""), held.value)
            pairs = np.unique(found.text * max(1, len(found.words)) + found.word) % max(1, len(found.words))
            for word, n in zip(found.words, np.bincount(pairs, minlength=len(found.words)).tolist()):
                total[word] = total.get(word, 0) + n
            if len(total) > 500_000:
                yield from out()
                total.clear()
        yield from out()

    summed = rows.mapInArrow(trimmed(count), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("nt"))
    return summed.join(terms, "term", "left_semi")


def _occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, content, start, end) of all occurrences in all texts; the bitmap tells the tasks which words to
    hand on, and a join with the terms decides."""
    held = send(rows.sparkSession, _marks(terms))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in column_batches(batches):
            out, texts = [], pc.fill_null(batch.column("text"), "")
            for i in np.unique(_Marked(texts, bits).text).tolist():
                text, doc_id = texts[i].as_py(), batch.column("doc_id")[i].as_py()
                key = _content(text)
                for m in WORD.finditer(text):
                    word = m.group().lower()
                    s = _slot(word)
                    if bits[s >> 3] >> (s & 7) & 1:
                        out.append((word, doc_id, key, m.start(), m.end()))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["term", "doc_id", "content", "start", "end"])

    found = rows.mapInArrow(trimmed(find), "term string, doc_id bigint, content bigint, start int, end int")
    return found.distinct().join(terms, "term")


def disclosures(
    df: DataFrame,
    remove: float = 0.9,
    generalise: float = 0.75,
    support: int = 2,
    words: int = 8,
    reach: int = 120,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and found (structs).

    Spans have code points of the text; base ones are the protected entities. A term (a word of three letters or more,
    in lower case) is a ``term`` or a ``hint`` where its highest share of an entity's information reaches ``remove`` or
    ``generalise``, among entities that it shares ``support`` distinct contexts or texts with: repeated rows add none.
    Null texts count as empty and have no spans. Rows without an id and repeated rows have results of their own; the
    latter count as often as they occur. Very long texts are searched whole; terms are candidates only near an entity.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unsend()
    scanned = cut(rows.mapInArrow(trimmed(_scan(words, reach)), ROWS))
    documents = scanned.count()
    mentions = scanned.filter(F.size("mentions") > 0).select(F.monotonically_increasing_id().alias("row"), "content", F.explode("mentions").alias("m")).select("row", "content", "m.*")
    holders = mentions.groupBy("entity").agg(F.count_distinct("row").alias("ne"))
    pairs = mentions.select("entity", "context", "content", F.explode("terms").alias("t")).select("entity", "context", "content", "t.*")
    pairs = pairs.groupBy("term", "entity", "context", "content").agg(F.sum("fresh").alias("c"))
    pairs = pairs.groupBy("term", "entity").agg(F.sum("c").alias("c"), F.count_distinct("context").alias("ways"), F.count_distinct("content").alias("texts"))
    pairs = cut(pairs.filter(F.greatest("ways", "texts") >= support).select("term", "entity", "c"))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    if pairs.isEmpty():
        return _rendered(scanned.select("doc_id", base.alias("found")))
    joint = pairs.join(holders, "entity").join(_holding(rows, pairs.select("term").distinct()), "term")
    both = F.least("c", "nt", "ne")
    pmi = F.log(both * F.lit(float(documents)) / (F.col("nt") * F.col("ne")))
    strength = F.when(F.col("ne") < documents, pmi / -F.log(F.col("ne") / F.lit(float(documents)))).otherwise(0.0)
    strong = cut(joint.groupBy("term").agg(F.max(strength).alias("strength")).filter(F.col("strength") >= generalise))
    if strong.isEmpty():
        return _rendered(scanned.select("doc_id", base.alias("found")))
    kind = F.when(F.col("strength") >= remove, 4).otherwise(5)
    more = _occurrences(rows, strong).select("doc_id", "content", F.struct("start", kind.cast("int").alias("kind"), "end").alias("x"))
    more = more.groupBy("doc_id", "content").agg(F.collect_list("x").alias("more")).withColumnRenamed("content", "key").withColumnRenamed("doc_id", "holder")
    met = scanned.join(more, (F.col("content") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("holder")), "left")
    outside = F.filter(F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return _rendered(met.select("doc_id", F.array_sort(F.concat(base, outside)).alias("found")))


def _rendered(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    of_kind = lambda i: F.filter("found", lambda x: x["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    base = F.filter("found", lambda x: x["kind"] < 4)
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), "found")


def cleaned(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with entities and hints as their kind in brackets and terms taken out; of overlapping spans the first
    counts and those that begin within it go with it."""
    out, at = [], 0
    for start, kind, end in sorted(found):
        if start >= at:
            out.append(text[at:start])
            out.append("" if KINDS[kind] == "term" else f"[{KINDS[kind]}]")
        at = max(at, end)
    return "".join([*out, text[at:]])
