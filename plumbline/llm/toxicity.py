"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration.

A token's log-odds come from the labelled documents in which it and its prefixes occur. With c documents, c1 of them
toxic, the rate is (c1 + a * parent) / (c + a): a Dirichlet prior of strength a around the rate of the next shorter
prefix, and of the whole sample at the root. Tokens unseen so far thus take their stem's rate. Less a constant, the
scores of clean text drift downwards, and the scan of Ruzzo and Tompa gives all maximal scoring segments of a document
in linear time. On clean documents the highest segment of m tokens follows an extreme-value law with P(max >= x) about
1 - exp(-K m exp(-lambda x)); lambda solves E[exp(lambda s)] = 1 over clean tokens, K is fitted to clean maxima. The
segments' normalised scores are summed up for a document and a logistic curve turns them into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_batches, crc_mod_column, forget, rows_where, send, staged, texts_of, trimmed, unsend

WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)


def features(token: str) -> list[str]:
    """The prefixes of a token from short to long, then the token itself."""
    return [*[token[:k] + "*" for k in PREFIXES if len(token) > k], token]


def tokens_of(raw: str) -> list[str]:
    return WORD.findall(raw.lower())


@dataclass
class Model:
    """Counts by feature and the calibration; its size is bounded by the sample it is fitted on."""

    counts: dict[str, tuple[int, int]]
    base: float
    strength: float = 10.0
    drift: float = 1.0
    rate: float = 1.0
    scale: float = 0.1
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    memo: dict[str, float] = field(default_factory=dict)

    def token_score(self, token: str) -> float:
        p = self.base
        for name in features(token):
            got = self.counts.get(name)
            if got:
                p = (got[1] + self.strength * p) / (got[0] + self.strength)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p)) - math.log(self.base / (1 - self.base)) - self.drift

    def raw_score(self, raw: str) -> float:
        """The highest score of the tokens in a stretch without white space."""
        return max(map(self.token_score, tokens_of(raw)), default=-self.drift)

    def scores(self, pieces: list[str]) -> np.ndarray:
        memo = self.memo
        got = list(map(memo.get, pieces))
        if None in got:
            if len(memo) > 100_000:
                memo.clear()
            for x in {x for x, s in zip(pieces, got) if s is None}:
                memo[x] = self.raw_score(x)
            got = [self.raw_score(x) if s is None and x not in memo else memo[x] if s is None else s for x, s in zip(pieces, got)]
        scores, seen = np.array(got, dtype=np.float64), set()
        for i in np.flatnonzero(scores > 0).tolist():  # the rates count documents, so a token tells once for each
            if pieces[i] in seen:
                scores[i] = -self.drift
            else:
                seen.add(pieces[i])
        return scores

    def segments(self, pieces: list[str]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.scores(pieces)) if pieces else []

    def describe(self, segments: list[tuple[int, int, float]], m: int) -> list[float]:
        """Calibrated features of a document: highest and summed normalised scores, highest raw score, 1."""
        if not segments:
            return [0.0, 0.0, 0.0, 1.0]
        beyond = math.log(self.scale * max(m, 1))
        normal = [max(0.0, self.rate * s - beyond) for _, _, s in segments]
        return [max(normal), math.log1p(sum(normal)), max(s for _, _, s in segments), 1.0]

    def probability(self, described: list[float]) -> float:
        z = sum(w * x for w, x in zip(self.weights, described))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), by the linear-time scan of Ruzzo and Tompa.

    Neighbouring tokens of one sign are one step of the scan, so it takes as many steps as there are runs.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive.view(np.int8))) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    before = np.concatenate([[0.0], np.cumsum(sums)])
    found: list[list] = []  # first, end, cumulative score before, cumulative score after, place of the last with less before
    for k in np.flatnonzero(positive[starts]):
        item = [int(starts[k]), int(ends[k]), float(before[k]), float(before[k + 1])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                found.append([*item, j])
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def root_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda with E[exp(lambda s)] = 1, by halving; 1 if clean scores never exceed 0."""
    if not (values > 0).any() or (values * counts).sum() >= 0:
        return 1.0
    p, lo, hi = counts / counts.sum(), 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * values, 500))).sum() > 1 else (mid, hi)
    return lo


def finish(model: Model, spread: Counter, parts: list[tuple[list, int, int]]) -> None:
    """Fit lambda, K and the logistic curve: ``spread`` counts clean tokens by score, ``parts`` has each document's
    segments, number of tokens and label; the counts of the model don't hold these documents."""
    clean = [x for x in parts if not x[2]]
    if spread:
        model.rate = root_rate(np.array(list(spread)), np.array(list(spread.values()), dtype=float))
        tails = [m * math.exp(-model.rate * max((s for *_, s in seg), default=0.0)) for seg, m, _ in clean if m]
        model.scale = max(1e-9, len(tails) / max(sum(tails), 1e-9))
    x = np.array([model.describe(seg, m) for seg, m, _ in parts]) if parts else np.zeros((0, 4))
    y = np.array([t for *_, t in parts], dtype=float)
    w = np.zeros(4)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(50):  # Newton's steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = np.diag([0.3, 0.3, 0.3, 1e-6])
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        w[:3] = np.maximum(w[:3], 0)
    else:
        w[3] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    model.weights = w.tolist()


def count_features(docs: Iterator[tuple[str, int]], room: int = 250_000) -> Iterator[dict[str, list[int]]]:
    """Documents with each feature, and toxic ones among them, as partial sums of about ``room`` features at most."""
    out: dict[str, list[int]] = {}
    for text, toxic in docs:
        for name in {f for raw in set(text.split()) for t in tokens_of(raw) for f in features(t)}:
            got = out.setdefault(name, [0, 0])
            got[0] += 1
            got[1] += toxic
        if len(out) > room:
            yield out
            out = {}
    yield out


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train=None) -> Model:
    """A model from at most ``most_rows`` labelled documents, those with the least hashes of their ids.

    ``train`` is a condition on ``labels``' ids; rows with a null id or label are left out, of several labels for an
    id the highest counts. Three quarters of the sample give the counts (only features that two documents share are
    kept), the last quarter the calibration. The bound on the sample bounds what is broadcast (ids and labels) and
    what reaches the driver (features, and the calibrating quarter's scores).
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if train is not None:
        known = known.filter(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("held"))
    unsend()
    sample = staged(sample, "sample")  # counts, totals and the calibration read it

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def docs_of() -> Iterator[tuple[str, int]]:
            for batch in column_batches(batches):
                yield from ((text, int(toxic > 0)) for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()))

        forget()
        for got in count_features(docs_of()):
            columns = [pa.array(list(got), pa.string()), *[pa.array([x[i] for x in got.values()], pa.int64()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["name", "c", "c1"])

    gathered = sample.filter("not held").mapInArrow(trimmed(counts), "name string, c bigint, c1 bigint")
    table = gathered.groupBy("name").agg(F.sum("c").alias("c"), F.sum("c1").alias("c1")).filter("c >= 2").toArrow().to_pydict()
    totals = {(r["held"], r["toxic"] > 0): r["count"] for r in sample.groupBy("held", "toxic").count().collect()}
    every = sum(n for (held, _), n in totals.items() if not held)
    toxic = sum(n for (held, t), n in totals.items() if t and not held)
    model = Model(dict(zip(table["name"], zip(table["c"], table["c1"]))), (toxic + 1) / (every + 10))
    calibrate_with(model, sample.filter("held").select("text", "toxic"))
    return model


def calibrate_with(model: Model, seen: DataFrame) -> None:
    """:func:`calibrate` on the texts of a DataFrame, which are reduced to their tokens' scores by the tasks."""
    held = send(seen.sparkSession, model)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in column_batches(batches):
            out = [[], [], [], [], []]
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                pieces = text.split()
                scores = m.scores(pieces) if pieces else np.zeros(0)
                values, counts = np.unique(np.round(scores, 1), return_counts=True)
                segments = maximal_segments(scores) if len(scores) else []
                for column, x in zip(out, (len(pieces), int(toxic > 0), values, counts, [s for *_, s in segments])):
                    column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["m", "toxic", "values", "counts", "segments"])

    rows = seen.mapInArrow(reduce, "m bigint, toxic int, values array<double>, counts array<bigint>, segments array<double>").toArrow().to_pylist()
    spread: Counter = Counter()
    for r in rows:
        if not r["toxic"]:
            for v, c in zip(r["values"], r["counts"]):
                spread[v] += c
    parts = [([(0, 0, s) for s in r["segments"]], r["m"], r["toxic"]) for r in rows]
    finish(model, spread, parts)


def segment_rows(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score (0 to 1), and the maximal segments that clean text of this length hardly has
    (expected number below 1) as code point spans with their score and expected number.

    Null texts count as empty: they have no segment and the score of a document without any. Rows without an id and
    repeated rows are scored like others, extra columns are ignored, an empty table gives no rows. ``model`` is of
    bounded size (see :func:`fit`) and sent to the tasks.
    """
    held = send(df.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = held.value
        for batch in column_batches(batches):
            scores, passages = [], []
            for text in texts_of(batch):
                pieces = text.split()
                found = m.segments(pieces)
                scores.append(m.probability(m.describe(found, len(pieces))))
                real = [(a, b, s, e) for a, b, s in found if (e := m.scale * len(pieces) * math.exp(-m.rate * s)) < 1]
                if real:
                    places = [x.span() for x in re.finditer(r"\S+", text)]
                    real = [(places[a][0], places[b - 1][1], s, e) for a, b, s, e in real if b <= len(places)]
                passages.append([dict(zip(("start", "end", "score", "expected"), x)) for x in real])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "segments"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(score), "doc_id bigint, score double, segments array<struct<start:bigint,end:bigint,score:double,expected:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """Scores of all documents from labels of those whose crc32(doc_id) mod 3 is not 1, in the form of op3's contract."""
    model = fit(docs, labels, most_rows, train=crc_mod_column("doc_id", 3) != 1)
    held_out = crc_mod_column("doc_id", 3) == 1
    scored = segment_rows(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")


def acceptable(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 20_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`toxicity` doesn't predict as toxic; nulls, very long texts
    and repeated rows are scored as there."""
    held = send(docs.sparkSession, fit(docs, labels, most_rows, text_col=text_col, train=crc_mod_column("doc_id", 3) != 1))

    def keep(texts: list[bytes]) -> list[bool]:
        m, out = held.value, []
        for text in texts:
            pieces = text.decode("utf-8", "replace").split()
            out.append(m.probability(m.describe(m.segments(pieces), len(pieces))) < threshold)
        return out

    return rows_where(docs, text_col, keep)
