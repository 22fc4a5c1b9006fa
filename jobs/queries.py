"""The jobs as registered queries: each runs its job twice into one new folder and returns the whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.plans import oracle
from echotrace.session import checkpoint_root
from jobs import copy_watch, detection_report


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_copy_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "job1")
    source = f"{sf_dir}/documents.parque[t]"  # the table may be a folder or a single file, which a file stream reads by a glob only
    for _ in range(2):
        found = copy_watch.run(spark, source, f"{folder}/out", f"{folder}/checkpoint")
    return found.drop("bucket")


def job2_detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's tables in one form: a row for each rejected row, cluster, member and edge."""
    folder = _new_folder(spark, "job2")
    for _ in range(2):
        t = detection_report.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", "2024-01-01", f"{sf_dir}/labels.parquet")
    rows = [
        t["rejected"].select(F.lit("rejected").alias("section"), F.col("ord").cast("string").alias("key"), F.col("rule").alias("detail"), F.col("at").cast("long").alias("n")),
        t["clusters"].select(F.lit("cluster"), "cluster_id", F.concat_ws(" ", "match_type", F.format_string("%.2f", "similarity"), "first_id", F.col("account_count").cast("string")), F.col("post_count").cast("long")),
        t["members"].select(F.lit("member"), "id", F.concat_ws(" ", "cluster_id", "account", "posted_at"), F.col("position").cast("long")),
        t["lines"].select(F.lit("line"), F.format_string("%d-%d", F.col("rank").cast("long"), F.col("position").cast("long")), "line", F.col("position").cast("long")),
        t["edges"].select(F.lit("edge"), "edge_id", F.concat_ws(" ", F.col("first_observed_ms").cast("string"), F.col("last_observed_ms").cast("string")), F.col("evidence_count").cast("long")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


QUERIES = {"job1_copy_watch": job1_copy_watch, "job2_detection_report": job2_detection_report}

_GONE = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
_BLANK = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''"
_LINE = oracle.csv("cluster_id", "match_type", "printf('%.2f', similarity)", "account_count", "post_count", "account", "url", "posted_at", "text")

ORACLES = {
    "job1_copy_watch": oracle.sql("""SELECT sum(posts) OVER t::BIGINT AS text_posts, count(*) OVER t::BIGINT AS text_accounts, first_value(first_id) OVER o AS origin_id, first_value(account) OVER o AS origin_account,
  first_value(first_ms) OVER o AS origin_ms, account, posts, first_id, first_ms, first_ms - first_value(first_ms) OVER o AS delay_ms FROM (
  SELECT norm, acct AS account, count(*)::BIGINT AS posts, first(id ORDER BY posted_ms, id) AS first_id, min(posted_ms) AS first_ms FROM prepared WHERE norm <> '' GROUP BY norm, acct)
WINDOW t AS (PARTITION BY norm), o AS (PARTITION BY norm ORDER BY first_ms, first_id) QUALIFY count(*) OVER t >= 2"""),
    "job2_detection_report": oracle.sql(
        f"""SELECT 'rejected' AS section, doc_id::VARCHAR AS key, 'text_required' AS detail, 5::BIGINT AS n FROM documents WHERE {_BLANK}
UNION ALL SELECT 'cluster', cluster_id, match_type || ' ' || printf('%.2f', similarity) || ' ' || (SELECT m.id FROM members m WHERE m.cluster_id = c.cluster_id AND m.position = 1) || ' ' || account_count, post_count FROM clusters c
UNION ALL SELECT 'member', id, cluster_id || ' ' || account || ' ' || posted_at, position::BIGINT FROM members
UNION ALL SELECT 'line', rank || '-' || position, {_LINE}, position::BIGINT FROM members
UNION ALL SELECT 'edge', edge_id, first_observed_ms || ' ' || last_observed_ms, evidence_count FROM account_edges""",
        {"posts": oracle.TABLES["posts"] + f" WHERE NOT coalesce({_GONE}, false) AND NOT {_BLANK}"},
    ),
}
