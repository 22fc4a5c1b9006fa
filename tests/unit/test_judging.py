import pytest
from pyspark.sql import functions as F

from echotrace.functions import judgment as J
from echotrace.operators import clusters, semantic
from echotrace.operators.graph import account_edges, cluster_edges
from echotrace.options import InputValidationError
from echotrace.plans import contracts
from echotrace.sources import posts as sources
from echotrace.sources.provider import PostSource


def test_responses(spark):
    rows = contracts.judge_responses(spark, "").collect()
    want = {r[0:1] + r[4:7] for r in contracts.RESPONSES}
    assert {(r.status_code, r.status, r.label, r.score) for r in rows} == want


def test_verdict_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("null",), ('"match"',), ('{"label":["match"],"score":1}',)], "c string")
    assert [r.v for r in rows.select(J.verdict(F.col("c")).alias("v")).collect()] == [None] * 4


def test_provider_needs_a_factory_and_something_to_ask(spark):
    spark.dataSource.register(PostSource)
    for options in ({}, {"provider": "x"}, {"provider": "a:b"}):
        with pytest.raises(Exception, match="provider|queries"):
            spark.read.format("posts").options(**options).load().collect()


def generated(spark, kind, size):
    posts = getattr(sources, f"{kind}_benchmark_posts")(spark, size)
    return clusters.cluster_table(clusters.all_members(clusters.prepare(posts))).collect()


def test_generated_posts_have_the_expected_clusters(spark):
    exact, near = generated(spark, "exact", 5000), generated(spark, "approximate", 1000)
    assert len(exact) == 500 and {r.post_count for r in exact} == {10}
    assert len(near) == 20 and {(r.post_count, r.similarity) for r in near} == {(50, 0.83)}


def test_posts_of_equal_token_sets_are_compared_once(spark):
    rows = [(0, "a", "red fox x"), (1, "a", "x fox red"), (2, "b", "fox x, red"), (3, "a", "one two"), (4, "a", "two one"), (5, "c", "blue cat y"), (6, "c", "cat blue y"), (7, "d", "blue cat y z")]
    posts = spark.createDataFrame([(o, str(o), a, f"https://e.example/{o}", "2024-01-01T00:00:00Z", 1000 + o, t) for o, a, t in rows], "ord long, id string, account string, url string, posted_at string, posted_ms long, text string")
    found = clusters.all_members(clusters.prepare(posts), clusters.DetectionOptions(threshold=0.7)).collect()
    got = {}
    for r in found:
        got.setdefault((r.match_type, r.cluster_key, r.sim), set()).add(r.ord)
    assert got == {("approximate", 0, 1.0): {0, 1, 2}, ("approximate", 5, 0.75): {5, 6, 7}}


def test_edges_from_sums_equal_edges_from_pairs(spark):
    members = [("C-1", "exact", 1.0, acct, ms) for acct, ms in (("a", 5), ("a", 9), ("b", 7), ("c", 1), ("b", 2))] + [("C-2", "approximate", 0.83, acct, ms) for acct, ms in (("b", 3), ("a", 4))]
    frame = spark.createDataFrame(members, "cluster_id string, match_type string, similarity double, acct string, posted_ms long")
    pairs = [(x[3], y[3], x[1], x[2], max(x[4], y[4])) for i, x in enumerate(members) for y in members[i + 1 :] if x[0] == y[0] and x[3] != y[3]]
    want = account_edges(spark.createDataFrame(pairs, "source string, target string, edge_type string, weight double, observed_ms long"))
    columns = ["edge_id", "evidence_count", "first_observed_ms", "last_observed_ms", F.round("weight", 6).alias("weight")]
    assert sorted(map(tuple, cluster_edges(frame).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_judge_request_errors(spark):
    rows = spark.createDataFrame([("c", "left", "right"), ("", " ", None), ("d", "x" * 4001, "🎉" * 2001), ("e", "x" * 4000 + " ", "🎉" * 2000)], "candidate_id string, leftText string, rightText string")
    got = {(r.candidate_id, r.rule) for r in semantic.request_errors(rows).collect()}
    assert got == {("", "candidate_id_required"), ("", "left_required"), ("", "right_required"), ("d", "left_too_long"), ("d", "right_too_long")}


def test_scan_csv(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('text,more,id,account,url,postedAt\n"a ""b"",\nc",1,7,alpha,u,t\n')
    assert [tuple(r)[1:] for r in sources.scan_csv(spark, str(tmp_path / "ok.csv")).collect()] == [("7", "alpha", "u", "t", 'a "b",\nc')]
    (tmp_path / "short.csv").write_text("id,account\n1,2\n")
    with pytest.raises(InputValidationError):
        sources.scan_csv(spark, str(tmp_path / "short.csv"))
    (tmp_path / "ragged.csv").write_text("id,account,url,postedAt,text\n1,2,3,4,5\n1,2\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        sources.scan_csv(spark, str(tmp_path / "ragged.csv")).collect()


def test_file_bytes_must_be_utf8(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfgr\xc3\xbcn")
    (tmp_path / "b.txt").write_bytes(b"gr\xfcn")
    assert sources.read_utf8(spark, str(tmp_path / "a.txt")) == "grün"
    with pytest.raises(InputValidationError):
        sources.read_utf8(spark, str(tmp_path / "b.txt"))
