"""The queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, class_lm, decontamination, exact_dedup, near_join, packing, sanitise, secret_scan, sentence_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return binary_output.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"), scope=200).drop("found")


def op3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from at most 20,000 labelled rows; ``segments`` are the significant passages."""
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, most_rows=20_000)
    return scored.withColumn("n_segments", F.size("segments").cast("long")).drop("segments")


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op6_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(_table(spark, sf_dir, "documents"))


def op7_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' benchmark passages; an item may differ in 8 % of its characters."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.08)


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.disclosures(_table(spark, sf_dir, "documents")).drop("found")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage with another one: which sentences, and which of all theirs are removed.

    Each holder of a passage has a row, the first one too, which loses nothing by it.
    """
    found = sentence_dedup.repeated_sentences(_table(spark, sf_dir, "documents"), span=2, least_words=25).filter(F.size("shared") > 0)
    both = [x for c in ("removed", "shared") for x in (F.size(c).cast("long").alias(f"n_{c}"), F.array_join(c, ",").alias(c))]
    return found.select("doc_id", "n_sentences", *both)


OP4_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w
), x AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT u AS id, u AS seen FROM e
  UNION
  SELECT r.id, e.v FROM r JOIN e ON e.u = r.seen
), c AS (
  SELECT id, min(seen) AS root FROM r GROUP BY id
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.id = s.doc_id
"""


OP10_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*'),
         lambda x: trim(regexp_replace(x, '[ \t-\r]+', ' ', 'g'), ' ')), lambda x: x <> '') AS s
  FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(list_transform(s, lambda x: len(string_split(x, ' ')))) AS words FROM d
), b AS (
  SELECT doc_id, pos, words, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w
), e AS (
  SELECT x.doc_id, x.pos, CASE WHEN x.words >= 50 THEN x.pos + 1 WHEN y.pos IS NOT NULL THEN greatest(x.pos + 2, y.pos + 1) END AS stop
  FROM b x ASOF LEFT JOIN b y ON x.doc_id = y.doc_id AND x.upto - x.words + 25 <= y.upto
), h AS (
  SELECT e.doc_id, pos, stop, array_to_string(s[pos + 1:stop], chr(10)) AS h FROM e JOIN d ON d.doc_id = e.doc_id WHERE stop <= len(s)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k,
         min(doc_id) OVER (PARTITION BY h) < max(doc_id) OVER (PARTITION BY h) AS shared FROM h
), c AS (
  SELECT doc_id, unnest(range(pos, stop)) AS i, k > 1 AS later, shared FROM o
), i AS (
  SELECT doc_id, i, bool_or(later) AS later, bool_or(shared) AS shared FROM c GROUP BY doc_id, i
)
SELECT d.doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_sentences,
       count(*) FILTER (WHERE later) AS n_removed, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE later), '') AS removed,
       count(*) FILTER (WHERE shared) AS n_shared, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE shared) AS shared
FROM d JOIN i ON i.doc_id = d.doc_id GROUP BY d.doc_id HAVING bool_or(shared)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_elias_fano, op2_linked_secrets, op3_segments, op4_grace_dedup, op5_best_fit, op6_class_bigrams, op7_jaccard_tiles, op8_edit_matches, op9_disclosure, op10_sentence_spans)}


def oracle_sql() -> dict[str, str]:
    return {"op4_grace_dedup": OP4_SQL, "op7_jaccard_tiles": OP7_SQL, "op10_sentence_spans": OP10_SQL}
