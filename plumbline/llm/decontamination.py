"""Benchmark decontamination by pigeonhole edit matching with bit-parallel verification."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, column_batches, kept, rows_where, send, trimmed, unsend

HITS = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint"


def normalised(text: bytes) -> str:
    """A-Z in lower case, white space as single spaces."""
    return b" ".join(text.translate(LOWER).split()).decode("utf-8", "replace")


def budget(m: int, rate: float) -> int:
    return int(m * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``k + 1`` pieces of nearly equal length: k errors leave one of them whole."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of ``text`` and the end of its first occurrence.

    Myers' bit vectors, one machine of m bits: a column's vertical differences are updated for a character at once.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best, end = score, j
        hp = (hp << 1) & full
        vp = ((hn << 1) & full) | (full & ~(d0 | hp))
        vn = hp & d0
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.peq: dict[int, tuple[dict, dict]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.empty = not where
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best occurrence of each item within its budget."""
        if self.empty:
            return []
        windows: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                windows.setdefault(number, []).append(end + 1 - length - offset)
        out = []
        for number, diagonals in windows.items():
            item, pattern, k = self.items[number]
            best = (k + 1, 0)
            for a, b in self._merged(sorted(diagonals), len(pattern) + k, k):
                part = text[max(0, a) : b]
                exact = part.find(pattern)
                got = (0, exact + len(pattern)) if exact >= 0 else myers(self._masks(number)[0], len(pattern), part)
                if got[0] < best[0]:
                    best = (got[0], max(0, a) + got[1])
            if best[0] <= k:
                distance, end = best
                back = text[max(0, end - len(pattern) - k) : end][::-1]
                start = end - (len(pattern) if not distance else myers(self._masks(number)[1], len(pattern), back)[1])
                out.append((item, distance, start, end))
        return out

    @staticmethod
    def _merged(diagonals: list[int], after: int, k: int) -> list[tuple[int, int]]:
        """Windows around the diagonals, one for those that overlap."""
        out: list[list[int]] = []
        for d in diagonals:
            if out and d - k <= out[-1][1]:
                out[-1][1] = max(out[-1][1], d + after)
            else:
                out.append([d - k, d + after])
        return [(a, b) for a, b in out]

    def _masks(self, number: int) -> tuple[dict, dict]:
        if number not in self.peq:
            text = self.items[number][1]
            self.peq[number] = (masks(text), masks(text[::-1]))
        return self.peq[number]


def original_places(raw: str, places: list[int]) -> list[int]:
    """Code points of the text at which code points of its normalised form stand; ends are given as place - 1."""
    at: list[int] = []
    gap = started = False
    for i, c in enumerate(raw):
        if c in " \t\n\x0b\x0c\r":
            gap = started
            continue
        if gap:
            at.append(i - 1)
            gap = False
        started = True
        at.append(i)
    return [at[p] for p in places]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    rate: float = 0.08,
    block_bytes: int = 2 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each item that a text holds with at most ``rate`` edits a character of the item.

    Columns: doc_id, item_id, distance, and start and end of the first best occurrence in code points of the text.
    Texts and items are compared in lower case (A-Z) with white space as single spaces; null and blank ones hold and
    match nothing. An item of fewer than 1 / rate characters has to occur exactly. Rows without an id and repeated
    rows are searched like others and give rows of their own; equal items of several ids all count. Extra columns are
    ignored, and without documents or items there are no rows.

    Items are a query set: blocks of about ``block_bytes`` of them, in as many scans as there are blocks, are sent to
    the tasks and searched in all whole texts.
    """
    unsend()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for held in _blocks(items, rate, block_bytes, item_id_col, item_text_col):
        hits = rows.mapInArrow(trimmed(_search(held)), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def _blocks(items: DataFrame, rate: float, block_bytes: int, item_id_col: str, item_text_col: str) -> Iterator:
    """Broadcasts of the items, in blocks of about ``block_bytes``."""
    query = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null").distinct()
    size = query.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    for block in range(blocks):
        part = query.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().to_pylist()
        texts = [(x["item_id"], normalised(x["text"].encode())) for x in part]
        texts.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield send(items.sparkSession, (uuid.uuid4().hex, texts, rate))


def _matcher(held) -> Matcher:
    """The matcher of this worker process for a block."""
    name, items, rate = held.value
    return kept(("matcher", name), lambda: Matcher(items, rate))


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_bytes: int = 2 << 20, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item; texts and items count as in :func:`contaminated`."""
    unsend()
    for held in _blocks(items, rate, block_bytes, item_id_col, item_text_col):

        def keep(texts: list[bytes], held=held) -> list[bool]:
            matcher = _matcher(held)
            return [not matcher.find(normalised(t)) for t in texts]

        docs = rows_where(docs, text_col, keep)
    return docs


def _search(held):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(held)
        for batch in column_batches(batches):
            out = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), bytes_of(batch)):
                for item, distance, start, end in matcher.find(normalised(raw)):
                    a, b = original_places(raw.decode("utf-8", "replace"), [start, end - 1]) if end > start else (0, -1)
                    out.append((doc_id, item, distance, a, b + 1))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "item_id", "distance", "start", "end"])

    return search
