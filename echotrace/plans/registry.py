"""The registered queries over the test tables, and their SQL.

The `documents` table stands in for posts: a document's source is its account and its
time is a minute of one day, so that times tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace import sinks
from echotrace.functions import text as T
from echotrace.operators import clusters as C
from echotrace.operators import evaluation, governance, graph, latercopy, semantic, simjoin, validate
from echotrace.options import DetectionOptions
from echotrace.plans import oracle
from echotrace.session import cut, keep, settled
from echotrace.sources import posts as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, other: dict[str, str] | None = None):
    """Register a query, with its SQL if it has any. Tables that it writes on the way are deleted when its result is written."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, d: settled(spark, lambda: f(spark, d))
        if sql is not None:
            ORACLES[name or f.__name__] = oracle.sql(sql, other)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts(spark: SparkSession, d: str) -> DataFrame:
    ms = F.lit(1704067200000) + F.col("doc_id") * 7919 % 1440 * 60000
    doc = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), doc.alias("id"), F.col("source").alias("account"), F.concat(F.lit("https://sns.example/"), "source", F.lit("/status/"), doc).alias("url"),
        F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"), ms.cast("long").alias("posted_ms"), "text",
    )


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return C.prepare(posts(spark, d))


def slim(spark: SparkSession, d: str, stored: bool = False) -> DataFrame:
    """Prepared posts without tokens."""
    return C.prepare(posts(spark, d), DetectionOptions(approximate=False), stored)


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """`(ord, acct, tokens)` with the tokens themselves, of the posts outside exact clusters."""
    own = keep(C.normalised(posts(spark, d)).select("ord", "acct", "posted_ms", "k1", "k2", (F.col("norm") == "").alias("blank"), T.tokens(F.col("norm")).alias("tokens")))
    return C.hashed_sets(C.leftovers(own, cut(C.exact_groups(own))))


def members(spark: SparkSession, d: str) -> DataFrame:
    return C.find_duplicate_clusters(posts(spark, d))


CLUSTER = ("cluster_id", "match_type", "similarity", "account_count", "post_count", "first_ms", "min_ord")


# exact clusters

@query("SELECT cluster_id, match_type, similarity, account_count, post_count, first_ms, min_ord FROM (" + oracle.clusters("exact") + ")")
def exact_clusters(spark, d):
    g = C.exact_groups(slim(spark, d)).withColumns({"match_type": F.lit("exact"), "similarity": F.lit(1.0), "cluster_key": F.col("min_ord")})
    return C.rank_clusters(g).select(*CLUSTER)


@query("SELECT cluster_key, id, account, posted_ms FROM exact")
def exact_cluster_members(spark, d):
    p = slim(spark, d, stored=True)
    return C.exact_members(p, C.exact_groups(p)).select("cluster_key", "id", "account", "posted_ms")


@query("SELECT min(ord) AS min_ord, count(*)::BIGINT AS post_count FROM prepared WHERE norm <> '' GROUP BY norm HAVING count(*) > 1 AND count(DISTINCT acct) = 1")
def same_account_only_dups(spark, d):
    g = slim(spark, d).groupBy("k1", "k2").agg(
        F.min("ord").alias("min_ord"), F.count(F.lit(1)).alias("post_count"), F.min("acct").alias("low"), F.max("acct").alias("high"), F.max("blank").alias("blank")
    )
    return g.where("post_count > 1 and low = high and not blank").select("min_ord", "post_count")


# text

@query("SELECT id, norm FROM prepared")
def normalized_text(spark, d):
    return C.normalised(posts(spark, d)).select("id", "norm")


@query(f"SELECT doc_id, {oracle.norm('text', False, False)} AS plain, {oracle.norm('text', True, False)} AS no_urls, {oracle.norm('text', False, True)} AS no_mentions FROM documents")
def mention_url_toggles(spark, d):
    n = lambda u, m: T.normalize_text(F.col("text"), u, m)
    return table(spark, d, "documents").select("doc_id", n(False, False).alias("plain"), n(True, False).alias("no_urls"), n(False, True).alias("no_mentions"))


@query(f"SELECT conv_id, turn, {oracle.norm('text')} AS norm FROM conversations")
def normalized_conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT ord, unnest({oracle.tokens('norm')}) AS token FROM prepared")
def token_sets(spark, d):
    return C.normalised(posts(spark, d)).select("ord", F.explode(T.tokens(F.col("norm"))).alias("token"))


@query("SELECT token, count(*)::BIGINT AS df FROM items GROUP BY token")
def token_document_frequency(spark, d):
    return simjoin.document_frequency(token_rows(spark, d))


@query("""SELECT ord, token FROM (SELECT ord, token, n, row_number() OVER (PARTITION BY ord ORDER BY df, token) AS r FROM items JOIN (SELECT token, count(*) AS df FROM items GROUP BY token) USING (token))
WHERE r <= n - ceil(n * 0.8::DOUBLE - 1e-9::DOUBLE) + 1""")
def prefix_tokens(spark, d):
    return simjoin.prefixes(token_rows(spark, d), 0.8)


MIXED = ["18時に公開", "市場abc", "ーー", "abc 東 カ ひら", "𠮷野 9_x", "", "é Ünï 12"]


@query("SELECT conv_id, turn, unnest(" + oracle.tokens("list_extract([" + ", ".join(f"'{t}'" for t in MIXED) + f"], conv_id % {len(MIXED)} + 1) || lower(text)") + ") AS token FROM conversations")
def mixed_script_tokens(spark, d):
    """Tokens of conversations behind texts of mixed scripts."""
    mixed = F.get(F.array(*map(F.lit, MIXED)), (F.col("conv_id") % len(MIXED)).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.tokens(F.concat(mixed, F.lower("text")))).alias("token"))


# similarity joins and clusters

def _pairs(threshold: float) -> Query:
    def run(spark, d):
        p = prepared(spark, d)
        return simjoin.similar_pairs(C.hashed_sets(C.leftovers(p, cut(C.exact_groups(p)))), threshold, stored=True)

    return run


for _t in (0.5, 0.65, 0.8, 1.0):
    query(f"SELECT a, b, inter, uni, sim FROM sims WHERE sim >= {_t}::DOUBLE", f"jaccard_pairs_{round(_t * 100):03d}")(_pairs(_t))


@query("SELECT cluster_id, match_type, similarity, account_count, post_count, first_ms, min_ord FROM (" + oracle.clusters("near") + ")")
def approx_clusters(spark, d):
    return C.cluster_table(C.all_members(prepared(spark, d)).where("match_type = 'approximate'")).select(*CLUSTER)


@query("SELECT cluster_key, ord, sim FROM near")
def approx_cluster_members(spark, d):
    return C.all_members(prepared(spark, d)).where("match_type = 'approximate'").select("cluster_key", "ord", "sim")


@query("SELECT cluster_id, match_type, similarity, account_count, post_count, first_ms, min_ord FROM clusters")
def duplicate_clusters(spark, d):
    return C.cluster_table(C.all_members(prepared(spark, d))).select(*CLUSTER)


@query("SELECT cluster_id, match_type, similarity, position, id, account, posted_at FROM members")
def duplicate_cluster_members(spark, d):
    return members(spark, d).select("cluster_id", "match_type", "similarity", "position", "id", "account", "posted_at")


# later copies

COPY = ("o_id", "c_id", "match_type", "similarity", "time_difference_ms")


@query("SELECT o_id, c_id, match_type, similarity, time_difference_ms FROM copies")
def later_copies_by_account(spark, d):
    return latercopy.in_order(latercopy.find_later_copies(posts(spark, d), account="@src3")).select(*COPY)


@query("SELECT o_id, c_id, match_type, similarity, time_difference_ms FROM copies WHERE match_type = 'exact'")
def later_copies_exact_only(spark, d):
    return latercopy.find_later_copies(posts(spark, d), account="SRC3", options=DetectionOptions(approximate=False)).select(*COPY)


@query("SELECT o_id, c_id, match_type, similarity, time_difference_ms FROM copies WHERE o_id = (SELECT min(ord)::VARCHAR FROM origin)")
def later_copies_by_post(spark, d):
    first = posts(spark, d).where("account = 'src3'").agg(F.min("ord").cast("string")).first()[0]
    return latercopy.find_later_copies(posts(spark, d), post_id=first).select(*COPY)


# semantic candidates and reconciliation

CANDIDATE = ("candidate_id", "left_id", "right_id", "lexical", "discovery", "lexical_similarity", "time_difference_ms")


def candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    m = members(spark, d)
    return m, semantic.create_candidates(posts(spark, d), m)


def judgments(c: DataFrame) -> DataFrame:
    """Judgments that are a function of the pair."""
    h = (F.col("left_ord") * 31 + F.col("right_ord") * 17) % 10
    return c.select(
        F.col("candidate_id").alias("candidateId"), F.when(h == 9, "unavailable").otherwise("completed").alias("status"),
        F.when(h <= 3, "match").when(h <= 6, "non_match").otherwise("abstain").alias("label"),
        ((F.col("left_ord") * 7 + F.col("right_ord") * 13) % 101 / 100).alias("score"), F.concat(F.lit("vendor/model-"), (F.col("left_ord") % 2).cast("string")).alias("resolvedModel"),
    )


@query("SELECT candidate_id, left_id, right_id, lexical, discovery, lexical_similarity, time_difference_ms FROM cands")
def semantic_candidates(spark, d):
    return candidates(spark, d)[1].select(*CANDIDATE)


@query("SELECT candidate_id, left_id, right_id, lexical, discovery, lexical_similarity, time_difference_ms FROM reviewed")
def semantic_review_top50(spark, d):
    return semantic.first_candidates(posts(spark, d), members(spark, d))[0].select(*CANDIDATE)


def reconciled(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    m, c = candidates(spark, d)
    return semantic.reconcile(posts(spark, d), m, c, judgments(c))


@query("SELECT cluster_id, match_type, similarity, account_count, post_count, first_ms, min_ord FROM after_clusters")
def reconciled_clusters(spark, d):
    return reconciled(spark, d)[1].select(*CLUSTER)


@query("SELECT (count(*) FILTER (added))::BIGINT AS added, (count(*) FILTER (excluded))::BIGINT AS excluded, (count(*) FILTER (kept))::BIGINT AS kept FROM decided")
def reconcile_counters(spark, d):
    m, c = candidates(spark, d)
    return semantic.adjudicate(c, judgments(c)).agg(*(F.count_if(x).alias(x) for x in ("added", "excluded", "kept")))


@query("""SELECT m.cluster_id, (count(*) FILTER (status = 'completed'))::BIGINT AS completed, (count(*) FILTER (status = 'completed' AND label = 'match'))::BIGINT AS matches,
  (count(*) FILTER (status = 'completed' AND label = 'non_match'))::BIGINT AS non_matches, (count(*) FILTER (status = 'completed' AND label = 'abstain'))::BIGINT AS abstained,
  (count(*) FILTER (status <> 'completed'))::BIGINT AS unavailable, max(CASE WHEN status = 'completed' THEN score END) AS highest_score,
  coalesce(array_to_string(list_sort(list_distinct(list(model) FILTER (status = 'completed'))), ','), '') AS models
FROM decided d JOIN after_members m ON m.ord = d.left_ord AND m.match_type = 'approximate' JOIN after_members o ON o.ord = d.right_ord AND o.cluster_id = m.cluster_id GROUP BY m.cluster_id""")
def cluster_judgment_summary(spark, d):
    m, _, decisions = reconciled(spark, d)
    s = semantic.cluster_summary(m, decisions)
    return s.withColumn("models", F.array_join(F.array_sort("resolved_models"), ",")).drop("resolved_models")


RUN_SUMMARY = """SELECT (SELECT count(*) FROM cands)::BIGINT AS total, count(*)::BIGINT AS reviewed, (count(*) FILTER (status = 'completed'))::BIGINT AS completed,
  (count(*) FILTER (status = 'completed' AND label = 'match'))::BIGINT AS matches, (count(*) FILTER (status = 'completed' AND label = 'non_match'))::BIGINT AS non_matches,
  (count(*) FILTER (status = 'completed' AND label = 'abstain'))::BIGINT AS abstained, (count(*) FILTER (status <> 'completed'))::BIGINT AS unavailable,
  (count(*) FILTER (added))::BIGINT AS added_by_semantic, (count(*) FILTER (excluded))::BIGINT AS excluded_by_semantic, greatest(0, (SELECT count(*) FROM cands) - count(*))::BIGINT AS skipped
FROM decided WHERE candidate_id IN (SELECT candidate_id FROM reviewed)"""

# the same, where pairs with a text over 4,000 UTF-16 units are refused
REFUSING_SUMMARY = RUN_SUMMARY.replace("FROM decided WHERE", """FROM (SELECT * REPLACE (CASE WHEN long_l OR long_r THEN 'unavailable' ELSE status END AS status, CASE WHEN long_l OR long_r THEN false ELSE added END AS added, CASE WHEN long_l OR long_r THEN false ELSE excluded END AS excluded)
  FROM decided JOIN units l ON l.o = left_ord JOIN units r ON r.o = right_ord) WHERE""").replace("long_l", "l.long").replace("long_r", "r.long")


@query(RUN_SUMMARY)
def run_summary(spark, d):
    seen, total = semantic.first_candidates(posts(spark, d), members(spark, d))
    seen = keep(seen)
    told = judgments(seen)
    return semantic.run_summary(total, told, semantic.adjudicate(seen, told)).withColumn("skipped", F.col("skipped").cast("long"))


# evaluation and cost

def cases(spark, d) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "labels")
    label = F.when(F.col("doc_id") % 10 == 0, "abstain").when(F.col("toxic") == 1, "non_match").otherwise("match")
    ids = F.col("doc_id").cast("string").alias("id")
    return own.select(ids, F.when(F.col("quality") == 1, "match").otherwise("non_match").alias("expected_label"), (F.col("doc_id") % 3).alias("category")), own.select(ids, label.alias("label"))


def _metrics_sql(by: str = "") -> str:
    n = lambda c: f"(count(*) FILTER ({c}))::BIGINT"
    tp, fp = n("expected = 'match' AND label = 'match'"), n("expected = 'non_match' AND label = 'match'")
    tn, fn = n("expected = 'non_match' AND label = 'non_match'"), n("expected = 'match' AND label = 'non_match'")
    share = lambda a, b: f"coalesce({a}::DOUBLE / nullif({b}, 0)::DOUBLE, 0)::DOUBLE"
    lead = f"{by}, " if by else ""
    return f"""SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM (SELECT {lead}count(*)::BIGINT AS total, {n("label <> 'abstain'")} AS decided, {n("label = 'abstain'")} AS abstained,
  {tp} AS true_positive, {fp} AS false_positive, {tn} AS true_negative, {fn} AS false_negative, {share(n("label = 'abstain'"), "count(*)")} AS abstention_rate,
  {share(tp, f"({tp} + {fp})")} AS precision, {share(tp, f"({tp} + {fn})")} AS recall, {share(f"({tp} + {tn})", n("label <> 'abstain'"))} AS accuracy, {share(fp, f"({fp} + {tn})")} AS false_positive_rate
FROM cases {"GROUP BY " + by if by else ""})"""


@query(_metrics_sql())
def eval_metrics(spark, d):
    return evaluation.metrics(*cases(spark, d))


@query(_metrics_sql("category"))
def eval_metrics_by_group(spark, d):
    return evaluation.metrics(*cases(spark, d), "category")


@query("""SELECT conv_id, turn, length(text)::DOUBLE / 1000000 * 0.4::DOUBLE + length(role)::DOUBLE / 1000000 * 1.6::DOUBLE + 0.003::DOUBLE AS cost,
  (length(text)::DOUBLE / 1000000 * 0.4::DOUBLE + length(role)::DOUBLE / 1000000 * 1.6::DOUBLE + 0.003::DOUBLE) * 30 + 5::DOUBLE AS monthly FROM conversations""")
def judgment_cost(spark, d):
    cost = evaluation.judgment_cost_column(F.length("text"), F.length("role"), 0.4, 1.6, 0.003)
    return table(spark, d, "conversations").select("conv_id", "turn", cost.alias("cost"), evaluation.monthly_cost(cost, F.lit(30), 5.0).alias("monthly"))


# sources and validation

def orders_as_export(spark, d) -> tuple[DataFrame, DataFrame]:
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    own = orders.select(
        F.col("o_orderkey").cast("long").alias("ord"), F.lit(True).alias("is_object"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("author_id"),
        F.col("o_orderdate").cast("string").alias("created_at"), F.lit("text").alias("text"),
    )
    named = customers.where("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("long").alias("pos"), F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("@"), "c_name").alias("username"))
    return own, named


@query("SELECT o_orderkey::VARCHAR AS id, c_name AS account FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0")
def username_lookup(spark, d):
    return S.join_authors(*orders_as_export(spark, d))[0].select("id", "account")


@query("SELECT o_orderkey::BIGINT AS ord, 'author_unknown' AS rule FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def unmatched_authors(spark, d):
    return S.join_authors(*orders_as_export(spark, d))[1].select("ord", "rule")


def raw_posts(spark, d) -> DataFrame:
    """Posts with planted faults: a repeated id, a plain URL, a time without zone, a blank text, a long account."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("ord"), F.when(k % 50 == 1, (k - 1).cast("string")).otherwise(k.cast("string")).alias("id"),
        F.when(k % 41 == 0, F.repeat(F.lit("a"), 31)).otherwise(F.concat(F.lit("@@"), "source")).alias("account"),
        F.when(k % 37 == 0, "http://sns.example/x").otherwise(F.concat(F.lit("HTTPS://sns.example/"), k.cast("string"))).alias("url"),
        F.when(k % 31 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T09:00:00+0900").alias("postedAt"), F.when(k % 29 == 0, " 　\n").otherwise(F.col("text")).alias("text"),
    )


BAD = "doc_id % 41 = 0 OR doc_id % 37 = 0 OR doc_id % 31 = 0 OR doc_id % 29 = 0"


@query(f"""SELECT doc_id AS ord, 'account_too_long' AS rule FROM documents WHERE doc_id % 41 = 0 UNION ALL SELECT doc_id, 'url_not_https' FROM documents WHERE doc_id % 37 = 0
UNION ALL SELECT doc_id, 'posted_at_not_iso' FROM documents WHERE doc_id % 31 = 0
UNION ALL SELECT doc_id, 'text_required' FROM documents WHERE doc_id % 29 = 0 OR trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) = ''
UNION ALL SELECT doc_id, 'id_repeated' FROM documents WHERE doc_id % 50 = 1 AND NOT ({BAD}) AND doc_id - 1 IN (SELECT doc_id FROM documents WHERE NOT ({BAD}))""")
def validation_errors(spark, d):
    return validate.validate(raw_posts(spark, d))[1].select("ord", "rule")


@query(f"SELECT doc_id AS ord, (doc_id - 1)::VARCHAR AS id FROM documents WHERE doc_id % 50 = 1 AND NOT ({BAD}) AND doc_id - 1 IN (SELECT doc_id FROM documents WHERE NOT ({BAD}))")
def duplicate_ids(spark, d):
    raw = raw_posts(spark, d)
    errors = validate.validate(raw)[1].where("rule = 'id_repeated'")
    return raw.select("ord", "id").join(errors.select("ord"), "ord", "left_semi")


@query("SELECT page_id, regexp_matches(url, '^[hH][tT][tT][pP][sS]://[^/]+') AS https FROM pages")
def https_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.is_https(F.col("url")).alias("https"))


# graph

def edges(spark, d) -> DataFrame:
    return graph.cluster_edges(members(spark, d))


EDGE = "source_account, target_account, edge_type, round(weight, 6) AS weight, evidence_count, first_observed_ms, last_observed_ms, edge_id"


def edge_columns(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.round("weight", 6))


@query(f"SELECT {EDGE} FROM account_edges")
def account_edges(spark, d):
    return edge_columns(edges(spark, d))


@query("SELECT acct AS account_id, min(account) AS handle, count(*)::BIGINT AS observed_post_count FROM prepared GROUP BY acct")
def account_nodes(spark, d):
    return graph.account_nodes(posts(spark, d))


@query(f"SELECT {EDGE} FROM account_edges WHERE edge_type = 'exact' AND evidence_count >= 2 AND last_observed_ms >= 1704088800000")
def graph_filtered(spark, d):
    return edge_columns(graph.filter_edges(edges(spark, d), ["exact"], 2, from_ms=1704088800000))


@query("SELECT edge_id, CASE WHEN (SELECT count(*) FROM account_edges WHERE edge_id > 'exact|src1|') > 10 THEN max(edge_id) OVER () END AS next_cursor FROM (SELECT edge_id FROM account_edges WHERE edge_id > 'exact|src1|' ORDER BY edge_id LIMIT 10)")
def graph_page(spark, d):
    return graph.page(edges(spark, d), 10, "exact|src1|").select("edge_id", "next_cursor")


# sinks

_LINE = oracle.csv("cluster_id", "match_type", "printf('%.2f', similarity)", "account_count", "post_count", "account", "url", "posted_at", "text")
_COPY_LINE = oracle.csv("o_id", "o_account", "o_url", "o_posted_at", "c_id", "c_account", "c_url", "c_posted_at", "floor(time_difference_ms / 1000 + 0.5)::BIGINT", "match_type", "printf('%.2f', similarity)", "c_text")


@query(f"SELECT rank, position, {_LINE} AS line FROM members")
def csv_cluster_lines(spark, d):
    return sinks.cluster_lines(members(spark, d))


@query(f"SELECT o_ord, c_ord, {_COPY_LINE} AS line FROM copies")
def csv_copy_lines(spark, d):
    return sinks.copy_lines(latercopy.find_later_copies(posts(spark, d), account="src3")).select("o_ord", "c_ord", "line")


@query("SELECT doc_id, " + oracle.CSV.format("(substr('=+-@', doc_id % 5, 1) || text)") + " AS cell FROM documents")
def csv_safe(spark, d):
    cell = F.concat(F.substr(F.lit("=+-@"), (F.col("doc_id") % 5).cast("int"), F.lit(1)), F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.csv_safe(F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(cell)).alias("cell"))


@query("""SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || '日' ELSE '' END || CASE WHEN s >= 3600 THEN (s % 86400 // 3600) || '時間' ELSE '' END
  || CASE WHEN s >= 60 THEN (s % 3600 // 60) || '分' ELSE '' END || (s % 60) || '秒' AS label FROM (SELECT event_id, floor(event_id * 7919 * 100 / 1000 + 0.5)::BIGINT AS s FROM events)""")
def duration_labels(spark, d):
    return table(spark, d, "events").select("event_id", T.duration_label(F.col("event_id") * 7919 * 100).alias("label"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("html"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS url FROM pages")
def url_encode_component(spark, d):
    return table(spark, d, "pages").select("page_id", T.encode_uri_component(F.col("url")).alias("url"))


@query()
def evidence_html(spark, d):
    return sinks.cluster_fragments(members(spark, d))


# governance

@query("""SELECT user_id, day, round(spent, 6) AS spent, round(running, 6) AS running, CASE WHEN running >= 5000 THEN 'stop' WHEN running >= 4000 THEN 'warn' ELSE 'ok' END AS state
FROM (SELECT *, sum(spent) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS running FROM usage)""")
def budget_running_usage(spark, d):
    own = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    out = governance.running_usage(own, "user_id", "day", "value", 5000.0)
    return out.withColumns({"spent": F.round("spent", 6), "running": F.round("running", 6)})


@query("SELECT event_id FROM events WHERE epoch_ms(ts) >= (SELECT max(epoch_ms(ts)) FROM events) - 7 * 86400000")
def retention_filter(spark, d):
    own = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    now = own.agg(F.max("ms")).first()[0]
    return governance.retained(own, "ms", now or 0, 7).select("event_id")


@query("SELECT cluster_id, count(*)::BIGINT AS post_count, count(DISTINCT acct)::BIGINT AS account_count FROM members WHERE ord % 3 <> 0 GROUP BY cluster_id")
def cascade_delete_recount(spark, d):
    gone = posts(spark, d).where("ord % 3 = 0").select("id")
    return governance.cascade_delete(members(spark, d), gone, "id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("post_count"), F.count_distinct("acct").alias("account_count"))


@query("SELECT avg((quality = 1)::INT)::DOUBLE AS good_rate, avg((toxic = 1)::INT)::DOUBLE AS toxic_rate, median(doc_id % 97)::DOUBLE AS median_minutes FROM labels")
def kpi_rates(spark, d):
    own = table(spark, d, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.col("doc_id") % 97).alias("minutes"))
    return governance.rates(own, ["good", "toxic"], "minutes")


@query("SELECT conv_id, turn, sha256(lower(trim(text)) || chr(31) || role) AS key FROM conversations")
def search_hashes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", governance.search_hash(F.col("text"), F.col("role")).alias("key"))
