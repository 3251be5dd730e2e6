"""Brown class-based bigrams: exchange clustering of words and smoothed scoring of whole texts.

Tokens are words (lower-cased A-Z, between characters of [\\x20\\x09-\\x0D]) and one end a text. A token's probability is
P(class | class before) * P(word | class). Classes are the end alone and ``CLASSES`` others:

1. the exchange algorithm moves the ``CLUSTERED`` commonest training words: each round counts, over all training texts,
   the classes before and after each of them, and moves every word to the class with the highest likelihood given the
   others. Meanwhile all other words stand in classes by their last letters, which is where an exchange starts from;
2. then every other training word, however rare, is moved by the same criterion: its neighbours' classes are summed up
   by word and held against the statistics of the last round. A word has one such move, and its neighbours' moves of
   the same round come after it.

Counts are exact and over all training tokens. Texts are numbered once, and all rounds read the numbers. Words with at
least a certain count, ``COMMON`` of them at most, are sent to the tasks; classes and counts of the others come from a
join with the tokens that remain, so all steps from and to them count and score as any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, bytes_of, column_batches, crc_mod_column, cut, partitions, send, staged, trimmed, unsend

CLASSES, TAILS, CLUSTERED, COMMON = 32, 31, 8192, 400_000
#: Class numbers: 0 the end, then exchanged ones, then those of last letters, which only the rounds have.
ALL = 1 + CLASSES + TAILS
BLOCK = 128
FORM = bytes(32 if bytes([b]) in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tail_class(word: bytes) -> int:
    return 1 + CLASSES + zlib.crc32(word[-3:]) % TAILS


class Tokens:
    """A batch's words, numbered: ``words`` the distinct ones, ``code`` all in order, ``ends`` where each text ends."""

    def __init__(self, texts: list[bytes]):
        shown = pa.array([t.translate(FORM) for t in texts], pa.large_binary())
        split = pc.split_pattern(shown, b" ")
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
        places = split.offsets.to_numpy().astype(np.int64)
        if b"" in self.words:
            real = code != self.words.index(b"")
            places = np.concatenate([[0], np.cumsum(real)])[places]
            code = code[real]
        self.code, self.ends = code, places[1:]

    def with_ends(self, value: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Values by word for all tokens, with ``end`` after each text; and where each text ends then."""
        return np.insert(value[self.code], self.ends, end), self.ends + np.arange(1, len(self.ends) + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of a task's training texts, summed up while there is room for a million words."""
    total: dict[bytes, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        names = list(total)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([total[x] for x in part], pa.int64())], ["word", "c"])

    for batch in column_batches(batches):
        tokens = Tokens(bytes_of(batch))
        counts = np.bincount(tokens.code, minlength=len(tokens.words)).tolist()
        for word, c in zip(tokens.words, counts):
            if c:
                total[word] = total.get(word, 0) + c
        if len(total) > 1_000_000:
            yield from out()
            total.clear()
    yield from out()


class Vocabulary:
    """The common words, their counts and classes; the first ``clustered`` are ordered by count."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, clustered: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.counts, self.total, self.distinct = counts, total, distinct
        self.clustered = min(clustered, len(words))
        self.classes = np.array([tail_class(w) for w in words], dtype=np.int64)
        self.classes[: self.clustered] = 1 + (self.classes[: self.clustered] - 1 - CLASSES) % CLASSES

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))


NUMBERED = "row bigint, doc_id bigint, train boolean, ids binary, rare array<binary>"


def _numbered(held):
    """Texts as the common words' numbers (32 bits each, -1 for any other word) and the other words in their order."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, made = held.value, TaskContext.get().partitionId() << 33
        for batch in column_batches(batches, 4 << 20):
            tokens = Tokens(bytes_of(batch))
            ids = vocabulary.ids(tokens.words)[tokens.code].astype("<i4")
            other, firsts = np.flatnonzero(ids < 0), np.concatenate([[0], tokens.ends])
            words = pa.array([tokens.words[i] for i in tokens.code[other].tolist()], pa.binary())
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, firsts).astype(np.int32)), words)
            data = [ids[x:y].tobytes() for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            columns = [pa.array(range(made, made + batch.num_rows), pa.int64()), batch.column("doc_id"), batch.column("train"), pa.array(data, pa.binary()), rare]
            made += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "train", "ids", "rare"])

    return trimmed(numbered)


class Numbered:
    """A batch of numbered texts: all ``ids``, where each text ``ends``, its other words' numbers in ``other``."""

    def __init__(self, batch: pa.RecordBatch):
        column, rare = batch.column("ids"), batch.column("rare")
        self.ids = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)
        self.ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)) // 4
        coded = rare.flatten().dictionary_encode()
        self.other, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def classes(self, vocabulary: Vocabulary, tails: bool) -> np.ndarray:
        """All tokens' classes; words that aren't common have that of their last letters, or -1."""
        out = vocabulary.classes[np.maximum(self.ids, 0)] if len(vocabulary.classes) else np.zeros(len(self.ids), dtype=np.int64)
        rare = np.array([tail_class(w) for w in self.words], dtype=np.int64)[self.other] if tails and len(self.other) else -1
        out[self.ids < 0] = rare
        return out

    def with_ends(self, value: np.ndarray, end) -> np.ndarray:
        """Values for all tokens with ``end`` after each text."""
        return np.insert(value, self.ends, end)

    def around(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes before and after all tokens, ends included; before and behind a text stands an end."""
        full = self.with_ends(cls, 0)
        return np.concatenate([[0], full[:-1]]), np.concatenate([full[1:], [0]])


def _neighbours(held, tails: bool):
    """For each clustered word the classes before (first half of the columns) and after it; and class pairs as block -1."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        blocks = -(-vocabulary.clustered // BLOCK) if tails else 0
        around = np.zeros(blocks * BLOCK * 2 * ALL, dtype=np.int64)
        pairs = np.zeros(ALL * ALL, dtype=np.int64)
        for batch in column_batches(batches):
            texts = Numbered(batch)
            own = texts.classes(vocabulary, tails)
            cls, word = texts.with_ends(own, 0), texts.with_ends(texts.ids, -1)
            before, after = texts.around(own)
            both = (before >= 0) & (cls >= 0)
            pairs += np.bincount(before[both] * ALL + cls[both], minlength=ALL * ALL)
            if blocks:
                known = (word >= 0) & (word < vocabulary.clustered)
                at = word[known] * (2 * ALL)
                around += np.bincount(np.concatenate([at + before[known], at + ALL + after[known]]), minlength=len(around))
        rows = around.astype("<i4" if around.max(initial=0) < 1 << 31 else "<i8").reshape(blocks, BLOCK * 2 * ALL)
        numbers = [-1, *range(blocks)]
        data = [pairs.astype("<i8").tobytes(), *(r.tobytes() for r in rows)]
        width = [8] + [rows.itemsize] * blocks
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(width, pa.int32()), pa.array(data, pa.binary())], ["block", "width", "data"])

    return trimmed(neighbours)


def _contexts(held):
    """(word, data) of training texts' words that aren't clustered: the classes before and (plus ``ALL``) after each."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        names = list(vocabulary.index)
        for batch in column_batches(batches):
            texts = Numbered(batch)
            before, after = texts.around(texts.classes(vocabulary, True))
            ids = texts.ids.copy()
            ids[ids < 0] = len(names) + texts.other
            word = texts.with_ends(ids, -1)
            at = np.flatnonzero(word >= vocabulary.clustered)
            at = at[np.argsort(word[at], kind="stable")]
            found, first = np.unique(word[at], return_index=True)
            data = np.stack([before[at], after[at] + ALL], axis=1).astype(np.uint8).tobytes()
            cuts = [*(2 * first).tolist(), len(data)]
            shown = [names[i] if i < len(names) else texts.words[i - len(names)] for i in found.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.binary()), pa.array([data[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())], ["word", "data"])

    return trimmed(contexts)


def gains(pairs: np.ndarray) -> np.ndarray:
    """What a neighbour adds to a word's likelihood in each class: rows for classes before, then for classes after it."""
    n = pairs.astype(np.float64)
    k, row, col = np.arange(1, 1 + CLASSES), n.sum(axis=1), n.sum(axis=0)
    left = np.log((n[:, k] + 0.1) / (row[:, None] + 1.0)) - np.log(col[k] + 1.0)
    right = np.log(n[k, :] + 0.1).T - np.log(row[k] + 1.0)
    return np.concatenate([left, right])


def _assigned(gain: np.ndarray):
    """(word, c, cls) from rows of :func:`_contexts` sorted by word: each word's count and best class."""

    def rows_of(words: list[bytes], seen: np.ndarray) -> pa.RecordBatch:
        cls = 1 + np.argmax(seen @ gain, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(seen.sum(axis=1) // 2, pa.int64()), pa.array(cls, pa.int32())], ["word", "c", "cls"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in column_batches(batches, 1 << 19):
            words, data = batch.column("word").to_pylist(), batch.column("data")
            codes, n = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.int64), len(words)
            of_row = np.repeat(np.arange(n), pc.binary_length(data).to_numpy())
            seen = np.bincount(of_row * (2 * ALL) + codes, minlength=n * 2 * ALL).reshape(n, 2 * ALL)
            starts = np.array([i for i in range(n) if not i or words[i] != words[i - 1]])
            seen, words = np.add.reduceat(seen, starts, axis=0), [words[i] for i in starts]
            if last == words[0]:
                seen[0] += total
            elif last is not None:
                yield rows_of([last], total[None, :])
            if len(words) > 1:
                yield rows_of(words[:-1], seen[:-1])
            last, total = words[-1], seen[-1]
        if last is not None:
            yield rows_of([last], total[None, :])

    return trimmed(assigned)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, width, data in zip(*(batch.column(c).to_pylist() for c in ("block", "width", "data"))):
            values = np.frombuffer(data, f"<i{width}").astype(np.int64)
            total[block] = total[block] + values if block in total else values
    width = pa.array([8] * len(total), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), width, pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "width", "data"])


def _gathered(train: DataFrame, vocabulary: Vocabulary, tails: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring classes of the clustered words, and counts of class pairs, over all training texts; without
    ``tails`` only the pairs of common words.

    Each task sends one row of fixed size for each block of words; a block's sum reaches the driver (16 MB in all).
    """
    held = send(train.sparkSession, vocabulary)
    parts = train.mapInArrow(_neighbours(held, tails), "block int, width int, data binary")
    # the tasks' rows are summed up in two steps, so none has to read them all, and one row for a block is left
    form, n = "block int, width int, data binary", partitions(train)
    fan = F.pmod(F.xxhash64(F.spark_partition_id(), "block"), F.lit(16))
    first = parts.withColumn("fan", fan).repartition(n, "block", "fan").select("block", "width", "data").mapInArrow(_summed, form)
    rows = first.repartition(n, "block").mapInArrow(_summed, form).toArrow()
    pairs = np.zeros(ALL * ALL, dtype=np.int64)
    around = np.zeros((-(-vocabulary.clustered // BLOCK), BLOCK * 2 * ALL), dtype=np.int64)
    for block, data in zip(rows.column("block").to_pylist(), rows.column("data").to_pylist()):
        values = np.frombuffer(data, "<i8")
        if block < 0:
            pairs += values
        else:
            around[block] += values
    return around.reshape(-1, 2 * ALL)[: vocabulary.clustered], pairs.reshape(ALL, ALL)


def exchange(classes: np.ndarray, around: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each clustered word's best class, given the counts of class pairs without the word's own share.

    The likelihood of a class bigram model changes by sum of L log P(k | c) + R log P(c | k) for the word's left and
    right neighbours' classes c; words are moved in order of their number, so statistics follow each move.
    """
    n = pairs.astype(np.float64)
    out = classes.copy()
    for w in range(len(out)):
        left, right, old = around[w, :ALL].astype(float), around[w, ALL:].astype(float), out[w]
        n[:, old] -= left
        n[old, :] -= right
        np.maximum(n, 0, out=n)
        k = np.arange(1, 1 + CLASSES)
        row, col = n.sum(axis=1), n.sum(axis=0)
        # gain of class k: pairs with this word's neighbours become commoner, the class itself too
        gain = left @ np.log((n[:, k] + 0.1) / (row[:, None] + 1.0)) + np.log((n[k, :] + 0.1)) @ right - right.sum() * np.log(row[k] + 1.0) - left.sum() * np.log(col[k] + 1.0)
        new = int(k[np.argmax(gain)])
        n[:, new] += left
        n[new, :] += right
        out[w] = new
    return out


class Model:
    """Log10 probabilities: of classes after classes, of words in classes."""

    def __init__(self, vocabulary: Vocabulary, pairs: np.ndarray, members: np.ndarray, sizes: np.ndarray, unknown: int, alpha: float = 10.0, delta: float = 0.1):
        n = pairs.astype(np.float64)
        single = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * len(n))
        self.transition = np.log10((n + alpha * single[None, :]) / (n.sum(axis=1, keepdims=True) + alpha))
        self.below = np.log10(sizes + delta * (members + 1))
        self.below[0] = 0.0
        self.delta, self.unknown = delta, unknown
        self.vocabulary = vocabulary
        self.base_below = float(np.log10(vocabulary.total + 0.1 * (vocabulary.distinct + 1)))


PARTS = "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double"


def _scored(held, end_count: int):
    """Each text's scores as far as common words and ends go: a step from or to any other word counts 0 here."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        vocabulary = model.vocabulary
        base_of = np.append(np.log10(vocabulary.counts + 0.1) - model.base_below, 0.0)
        emit_of = np.append(np.log10(vocabulary.counts + model.delta) - model.below[vocabulary.classes], 0.0)
        end_base = float(np.log10(end_count + 0.1)) - model.base_below
        for batch in column_batches(batches):
            texts = Numbered(batch)
            own = texts.classes(vocabulary, False)
            cls, (before, _) = texts.with_ends(own, 0), texts.around(own)
            ends = texts.ends + np.arange(1, len(texts.ends) + 1)
            steps = np.where((before >= 0) & (cls >= 0), model.transition[before, cls], 0.0) + texts.with_ends(emit_of[texts.ids], 0.0)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            known = sums(texts.with_ends((texts.ids >= 0).astype(np.int64), int(end_count > 0)))
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()), pa.array(known, pa.int64()), pa.array(sums(texts.with_ends(base_of[texts.ids], end_base)), pa.float64()), pa.array(sums(steps), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "base", "score"])

    return trimmed(scored)


def _others(held):
    """(row, train, at, word, before, after) of each word that isn't common; -1 for a neighbour that isn't either."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in column_batches(batches):
            texts = Numbered(batch)
            before, after = texts.around(texts.classes(vocabulary, False))
            at = np.flatnonzero(texts.with_ends(texts.ids, 0) < 0)
            text = np.searchsorted(texts.ends + np.arange(1, len(texts.ends) + 1), at, side="right")
            columns = [batch.column("row").take(pa.array(text)), batch.column("train").take(pa.array(text)), pa.array(at, pa.int64()), batch.column("rare").flatten(), pa.array(before[at], pa.int32()), pa.array(after[at], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "train", "at", "word", "before", "after"])

    return trimmed(others)


def learned(df: DataFrame, rounds: int = 3, clustered: int = CLUSTERED, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """The numbered texts, the vocabulary with final classes, (word, c, cls) of words that aren't clustered, how many
    training texts there are, and the least count of a common word."""
    unsend()
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_mod_column(f"`{id_col}`", 10) != 0).alias("train"))
    train = rows.filter("train")
    counts = staged(train.mapInArrow(trimmed(_count), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    texts = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count that leaves ``common`` words at most
    levels = counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toArrow()
    fits = np.cumsum(levels.column("k").to_numpy()) <= common
    least = int(levels.column("c").to_numpy()[fits][-1]) if fits.any() else 1 << 62
    top = counts.filter(F.col("c") >= least).toArrow()
    found, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(found)), key=lambda i: (-c[i], found[i]))
    # the end is a token
    vocabulary = Vocabulary([found[i] for i in order], c[order], total + texts, distinct + int(texts > 0), clustered)
    numbered = staged(rows.mapInArrow(_numbered(send(spark, vocabulary)), NUMBERED), "numbered")
    seen = numbered.filter("train")
    for _ in range(rounds):
        around, pairs = _gathered(seen, vocabulary)
        vocabulary.classes[: vocabulary.clustered] = exchange(vocabulary.classes[: vocabulary.clustered], around, pairs)
    _, pairs = _gathered(seen, vocabulary)
    # all other words, common or not, by their neighbours against these statistics
    contexts = seen.mapInArrow(_contexts(send(spark, vocabulary)), "word binary, data binary")
    dealt = contexts.repartition(partitions(df), "word").sortWithinPartitions("word")
    assigned = staged(dealt.mapInArrow(_assigned(gains(pairs)), "word binary, c bigint, cls int"), "classes")
    more = assigned.filter(F.col("c") >= least).select("word", "cls").toArrow()
    vocabulary.classes[vocabulary.ids(more.column("word").to_pylist())] = more.column("cls").to_numpy()
    return numbered, vocabulary, assigned, texts, least


def class_scores(df: DataFrame, rounds: int = 3, clustered: int = CLUSTERED, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on rows whose crc32(doc_id as text) mod 10 is not 0 (a null id counts as empty text, so it is not used).
    Null texts count as empty: the end alone. Repeated rows count as often as they occur and have rows of their own.
    base_score is the add-0.1 unigram's log10 probability, score the class model's. Very long texts are one row like
    any other. Other columns are ignored; an empty table gives no rows.
    """
    spark, n = df.sparkSession, 1 + CLASSES
    numbered, vocabulary, assigned, texts, least = learned(df, rounds, clustered, common, id_col, text_col)
    rest = assigned.filter(F.col("c") < least)
    members, sizes, once = np.bincount(vocabulary.classes, minlength=n)[:n], np.bincount(vocabulary.classes, weights=vocabulary.counts, minlength=n)[:n], np.zeros(n)
    for r in rest.groupBy("cls").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        members[r["cls"]] += r["k"]
        sizes[r["cls"]] += r["n"]
        once[r["cls"]] = r["once"]
    unknown = int(np.argmax(once)) or 1  # words never seen are taken for the class with the most words seen once

    held = send(spark, vocabulary)
    others = numbered.filter(F.size("rare") > 0).mapInArrow(_others(held), "row bigint, train boolean, at bigint, word binary, before int, after int")
    met = others.join(rest, "word", "left").withColumns({"c": F.coalesce("c", F.lit(0)), "cls": F.coalesce("cls", F.lit(unknown))})
    by = Window.partitionBy("row").orderBy("at")  # where the word before isn't common, it is the row before
    met = cut(met.select("row", "train", "c", "cls", "after", F.when(F.col("before") >= 0, F.col("before")).otherwise(F.lag("cls").over(by)).alias("before")))
    _, pairs = _gathered(numbered.filter("train"), vocabulary, tails=False)
    pairs = pairs[:n, :n].copy()
    steps = met.filter("train").select(F.explode(F.array(F.struct("before", F.col("cls").alias("to")), F.struct(F.col("cls").alias("before"), F.col("after").alias("to")))).alias("s")).filter("s.to >= 0")
    for r in steps.groupBy("s.before", "s.to").count().collect():
        pairs[r["before"], r["to"]] += r["count"]
    model = Model(vocabulary, pairs, members, sizes, unknown)
    parts = numbered.mapInArrow(_scored(send(spark, model), texts), PARTS)

    below = F.get(F.array(*[F.lit(float(x)) for x in model.below]), F.col("cls"))
    table = F.array(*[F.lit(float(x)) for x in model.transition.ravel()])
    step = lambda x, y: F.get(table, x * n + y)
    own = step(F.col("before"), F.col("cls")) + F.when(F.col("after") >= 0, step(F.col("cls"), F.col("after"))).otherwise(0.0)
    more = met.groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("known2"),
        F.sum(F.log10(F.col("c") + 0.1) - F.lit(model.base_below)).alias("base2"),
        F.sum(own + F.log10(F.col("c") + F.lit(model.delta)) - below).alias("score2"),
    )
    both = parts.join(more, "row", "left")
    return both.select(
        "doc_id",
        (crc_mod_column("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
    )
