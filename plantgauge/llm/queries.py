"""Queries p1, p4, p5, p7, p8 and p9, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .abuse import abuse_scores
from .leaks import leaked_items
from .multiselect import clean_scores, day_summaries, from_summaries, multi_select
from .overlap import cross_split_pairs, overlap_fractions
from .runs import LOOKALIKES, collapse_runs, level_of
from .tokens import encode_corpus

GROUP = ["equipment_id", "labels"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file lies: in the folder TOKENIZERS names, else beside the installed module."""
    if folder := os.environ.get("TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "episodes"), level_of(F.col("peak_level")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("level IS NOT NULL AND n_events >= 2").select("run_id", F.col("first_idx").alias("first_start_window_idx"), F.col("last_idx").alias("last_start_window_idx"))


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch as one event with its number of episodes and its duration."""
    return _runs(spark, d).select("run_id", "level", F.col("first_idx").alias("first_start_window_idx"), F.col("last_idx").alias("last_start_window_idx"), "n_events", "duration_s")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, d, "cleaned_windows"), table(spark, d, "eval_windows"))
    return pairs.select(F.least("train_id", "out_id").alias("record_id_a"), F.greatest("train_id", "out_id").alias("record_id_b"))


def p4_per_split(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out split and source: records, records that overlap with training, and pairs by kind."""
    held = table(spark, d, "eval_windows")
    pairs = cross_split_pairs(table(spark, d, "cleaned_windows"), held)
    per = pairs.groupBy(F.col("out_id").alias("record_id")).agg(F.count_if(F.col("how") != "values").alias("same_window"), F.count_if(F.col("how") != "window").alias("near_values"), F.count("*").alias("pairs"))
    once = held.select("record_id", "split", "source").where("record_id IS NOT NULL").distinct()
    return once.join(per, "record_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("same_window"), F.lit(0)).alias("n_same_window"), F.coalesce(F.sum("near_values"), F.lit(0)).alias("n_near_values")
    )


def p4_fractions(spark: SparkSession, d: str) -> DataFrame:
    return overlap_fractions(table(spark, d, "cleaned_windows"), table(spark, d, "eval_windows"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles: the stated bound on the error is 0."""
    scores = clean_scores(table(spark, d, "window_scores")).withColumn("w", F.lit(1))
    return multi_select(scores, GROUP).withColumn("max_rank_error", F.lit(0).cast("long"))


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of single days, to be combined by adding up n."""
    return day_summaries(clean_scores(table(spark, d, "window_scores")), GROUP)


def p5_from_days(spark: SparkSession, d: str) -> DataFrame:
    return from_summaries(p5_daily(spark, d), GROUP)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), tokenizer_path())


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id")


def p8_per_item(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item: the number of documents that leak it, and the longest row of its words in any."""
    items = table(spark, d, "eval_items").select("item_id", "suite").where("item_id IS NOT NULL").dropDuplicates(["item_id"])
    per = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.max("n_words").alias("most"))
    return items.join(per, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("most", F.lit(0)).alias("longest_words"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("score >= 0.5").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, abusive ones, their share and the mean score."""
    abusive = F.count_if(F.col("score") >= 0.5)
    return p9_scores(spark, d).groupBy("source").agg(F.count("*").alias("n_documents"), abusive.alias("n_abusive"), (abusive / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_events, p4_found, p4_per_split, p4_fractions, p5_percentiles, p5_daily, p5_from_days, p7_ids, p8_found, p8_per_item, p9_scores, p9_found, p9_rates)}

_FROM, _TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
_RUNS = f"""
WITH spelt AS (
  SELECT DISTINCT run_id, start_window_idx AS idx, episode_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e,
    regexp_replace(translate(lower(translate(peak_level, '{"".join(chr(0xFF01 + i) for i in range(94))}', '{"".join(chr(0x21 + i) for i in range(94)).replace("'", "''")}')), '{_FROM}', '{_TO}'), '[^a-z]', '', 'g') AS t
  FROM episodes WHERE run_id IS NOT NULL AND start_window_idx IS NOT NULL AND episode_id IS NOT NULL),
levelled AS (
  SELECT *, CASE WHEN t = '' THEN NULL
    WHEN levenshtein(t, 'yellow') <= 2 OR list_sort(string_split(t, '')) = ['e', 'l', 'l', 'o', 'w', 'y'] THEN 'yellow'
    WHEN levenshtein(t, 'red') <= 1 OR list_sort(string_split(t, '')) = ['d', 'e', 'r'] THEN 'red' END AS level FROM spelt),
before AS (SELECT *, lag(level) OVER o AS l0, lag(idx) OVER o AS i0 FROM levelled WINDOW o AS (PARTITION BY run_id ORDER BY idx, episode_id)),
named AS (SELECT *, sum(CASE WHEN level = l0 AND idx - i0 <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY idx, episode_id) AS k FROM before),
stretch AS (SELECT run_id, k, max(level) AS level, min(idx) AS first_start_window_idx, max(idx) AS last_start_window_idx, count(*) AS n_events, (max(e) - min(s)) // 1000000 AS duration_s FROM named GROUP BY run_id, k)
"""
_SCORES = """
WITH once AS (SELECT DISTINCT window_id, equipment_id, labels, CAST(window_start AS DATE) AS day, window_score AS v FROM window_scores WHERE window_score IS NOT NULL AND NOT isnan(window_score))
"""
SQL = {
    "p1_found": _RUNS + "SELECT run_id, first_start_window_idx, last_start_window_idx FROM stretch WHERE level IS NOT NULL AND n_events >= 2",
    "p1_events": _RUNS + "SELECT run_id, level, first_start_window_idx, last_start_window_idx, n_events, duration_s FROM stretch",
    "p5_percentiles": _SCORES
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY equipment_id, labels ORDER BY v) AS r, count(*) OVER (PARTITION BY equipment_id, labels) AS n FROM once)
SELECT equipment_id, labels, max(n) AS n, max(v) FILTER (r = (500 * n + 999) // 1000) AS p50, max(v) FILTER (r = (900 * n + 999) // 1000) AS p90,
  max(v) FILTER (r = (950 * n + 999) // 1000) AS p95, max(v) FILTER (r = (990 * n + 999) // 1000) AS p99, CAST(0 AS BIGINT) AS max_rank_error FROM ranked GROUP BY equipment_id, labels""",
    "p5_daily": _SCORES
    + """SELECT equipment_id, labels, day, CASE WHEN v = 0 THEN 0 ELSE sign(v) * (CAST(ceil(ln(abs(v)) / ln(1.005::DOUBLE / 0.995::DOUBLE)) AS BIGINT) + 1048576) END::BIGINT AS bucket, count(*) AS n
FROM once GROUP BY ALL""",
}

_NEAR = """
WITH a AS (SELECT DISTINCT record_id, equipment_id, cleaned_window_ids AS win, sensor_means AS m FROM cleaned_windows),
b AS (SELECT DISTINCT record_id, equipment_id, window_ids AS win, sensor_means AS m FROM eval_windows),
gaps AS (SELECT a.record_id AS ra, b.record_id AS rb, list_filter(list_transform(list_zip(a.m, b.m), lambda x: abs(x[1] - x[2])), lambda g: g IS NOT NULL) AS g FROM a, b WHERE a.m IS NOT NULL AND b.m IS NOT NULL),
pairs AS (
  SELECT ra, rb FROM gaps WHERE len(g) >= 10 AND list_max(g) <= 0.05 + 1e-9
  UNION SELECT a.record_id, b.record_id FROM a JOIN b USING (equipment_id, win))
"""
SQL["p4_found"] = _NEAR + "SELECT least(ra, rb) AS record_id_a, greatest(ra, rb) AS record_id_b FROM pairs"
SQL["p4_per_split"] = (
    _NEAR.replace("pairs AS (", "near AS (SELECT ra, rb FROM gaps WHERE len(g) >= 10 AND list_max(g) <= 0.05 + 1e-9), same AS (SELECT a.record_id AS ra, b.record_id AS rb FROM a JOIN b USING (equipment_id, win)),\npairs AS (")
    + """, k AS (SELECT rb, count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM same s WHERE s.ra = p.ra AND s.rb = p.rb)) AS s, count(*) FILTER (EXISTS (SELECT 1 FROM near n WHERE n.ra = p.ra AND n.rb = p.rb)) AS n FROM pairs p GROUP BY rb),
o AS (SELECT DISTINCT record_id, split, source FROM eval_windows)
SELECT split, source, count(*) AS n_records, count(pairs) AS n_overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS n_pairs, CAST(coalesce(sum(s), 0) AS BIGINT) AS n_same_window, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_near_values FROM o LEFT JOIN k ON k.rb = o.record_id GROUP BY ALL"""
)
