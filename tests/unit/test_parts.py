import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from echotrace.functions import text as T
from echotrace.operators import evaluation, governance, graph
from echotrace.operators.components import connected_components, extended
from echotrace.operators.ranking import global_row_number
from echotrace.options import DetectionOptions


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def test_normal_text(spark):
    assert one(spark, T.normalize_text, " ＡＢＣ　@Alpha\nhttps://example.com/test  ") == "abc"
    assert one(spark, T.nfkc, "ＡＢＣ　①ｶﾞ") == "ABC 1ガ"
    assert one(spark, T.js_trim, "﻿  x\u0085") == "x\u0085"


def test_tokens(spark):
    assert one(spark, T.tokens, "18時に公開") == ["18", "8時", "時に", "に公", "公開"]
    assert one(spark, T.tokens, "市場abc") == ["市場", "abc"]
    assert one(spark, T.tokens, "ーー") == ["ーー"]
    assert len(one(spark, T.tokens, "𠮷野")) == 1 and len(one(spark, T.utf16_tokens, "𠮷野")) == 2
    row = spark.createDataFrame([("市場 ニュース 速報", "市場 ニュース 更新")], "a string, b string").select(T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))).alias("j")).first()
    assert row.j == 2 / 3


def test_rounding_is_exact(spark):
    values = sorted({i / u for u in range(1, 121) for i in range(u + 1)})
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.to_fixed2(F.col("v")).alias("x")).collect()
    for r in got:
        assert r.x == float(Decimal(r.v).quantize(Decimal("0.01"), ROUND_HALF_UP)), r.v


def test_labels(spark):
    assert one(spark, T.duration_label, 120_000, "long") == "2分0秒"
    assert one(spark, T.duration_label, 90_061_000, "long") == "1日1時間1分1秒"
    assert one(spark, lambda c: T.ordinal_id("C-", c), 1000, "long") == "C-1000"
    assert one(spark, T.round_half_up, -1.5, "double") == -1
    assert one(spark, T.encode_uri_component, "a b~!'()*é") == "a%20b~!'()*%C3%A9"
    for url, ok in (("https://a.example/x", True), ("HTTPS://a.example", True), ("http://a.example", False), ("https://", False), ("", False), (None, False)):
        assert one(spark, T.is_https, url) is ok
    for at, ok in (("2026-01-01T00:00:00Z", True), ("2026-01-01T00:00:00+09:00", True), ("2026-01-01T00:00:00", False), ("soon Z", False)):
        assert (one(spark, T.iso_ms, at) is not None) is ok


def test_options():
    with pytest.raises(TypeError):
        DetectionOptions(approximate=1)
    for bad in (0.4, 1.1, math.nan, "0.8"):
        with pytest.raises(ValueError):
            DetectionOptions(threshold=bad)


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(300)] + [(3000, 3001 + i) for i in range(500)] + [(5000 - i, 4000) for i in range(200)]
    edges += [(7, 7), (None, 3), (8, None), edges[0], edges[0][::-1]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    first, more = spark.createDataFrame(edges[::2], "a long, b long"), spark.createDataFrame(edges[1::2], "a long, b long")
    whole = extended(connected_components(first, "a", "b"), more, "a", "b")
    assert {r.node: r.component for r in whole.collect()} == got
    assert whole.count() == len(got)


def test_global_row_number(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000)
    got = global_row_number(df, "n", [F.expr("k div 100")], [F.col("k")]).collect()
    assert all(r.n == r.k + 1 for r in got)


def test_metrics(spark):
    cases = spark.createDataFrame([("1", "match"), ("2", "match"), ("3", "non_match"), ("4", "non_match"), ("5", "match")], "id string, expected_label string")
    told = spark.createDataFrame([("1", "match"), ("2", "non_match"), ("3", "match"), ("4", "non_match"), ("5", "abstain")], "id string, label string")
    evaluation.check_predictions(cases, told)
    m = evaluation.metrics(cases, told).first()
    assert (m.total, m.decided, m.abstained, m.precision, m.recall, m.f1, m.accuracy, m.false_positive_rate, m.abstention_rate) == (5, 4, 1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.2)
    none = evaluation.metrics(cases, told.withColumn("label", F.lit("abstain"))).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0, 0, 0, 0)
    for c, p in ((cases.limit(0), told), (cases, told.limit(3)), (cases, told.union(told.limit(1))), (cases.withColumn("expected_label", F.lit("abstain")), told)):
        with pytest.raises(ValueError):
            evaluation.check_predictions(c, p)
    assert evaluation.judgment_cost(2500, 250, 0.4, 1.6, 0.003) == pytest.approx(0.0044)
    for bad in (-1, math.inf, "1"):
        with pytest.raises(TypeError):
            evaluation.judgment_cost(bad, 0, 0, 0)


def test_graph(spark):
    rows = [("b", "a", "exact", 1.0, 5), ("a", "b", "exact", 0.5, 3), ("a", "a", "exact", 1.0, 1), ("a", "c", "approximate", 0.8, 9)]
    edges = graph.account_edges(spark.createDataFrame(rows, "source string, target string, edge_type string, weight double, observed_ms long"))
    got = {r.edge_id: (r.weight, r.evidence_count, r.first_observed_ms, r.last_observed_ms) for r in edges.collect()}
    assert got == {"exact|a|b": (1.5, 2, 3, 5), "approximate|a|c": (0.8, 1, 9, 9)}
    nodes = graph.account_nodes(spark.createDataFrame([("A",), ("a",), ("b",)], "account string"))
    assert [r.edge_id for r in graph.broken_edges(edges, nodes).collect()] == ["approximate|a|c"]
    first = graph.page(edges, 1).collect()
    assert [(r.edge_id, r.next_cursor) for r in first] == [("approximate|a|c", "approximate|a|c")]
    assert [(r.edge_id, r.next_cursor) for r in graph.page(edges, 1, "approximate|a|c").collect()] == [("exact|a|b", None)]
    assert '"schemaVersion":"1.0"' in graph.response(nodes, edges, {"limit": 1}).first().document
    assert graph.filter_edges(edges, ["exact"], 2, 4, 9).count() == 1


def test_governance(spark):
    use = spark.createDataFrame([("k", "d1", 70.0), ("k", "d2", 15.0), ("k", "d3", 20.0)], "key string, day string, v double")
    assert [r.state for r in governance.running_usage(use, "key", "day", "v", 100.0).orderBy("day").collect()] == ["ok", "warn", "stop"]
    events = spark.createDataFrame([("r", 1, "quoted"), ("r", 2, "reserved"), ("r", 3, "settled"), ("s", 1, "running")], "reservation_id string, at int, state string")
    assert sorted((r.reservation_id, r.state) for r in governance.bad_transitions(events).collect()) == [("r", "settled"), ("s", "running")]


def test_stream_of_copies(spark, tmp_path):
    from echotrace.streaming.later_copies import copies_of

    schema = "id string, account string, ts timestamp, text string"
    rows = spark.createDataFrame([("2", "b", "Same text", 5), ("3", "a", "same text", 6), ("4", "c", "same  TEXT", 0)], "id string, account string, text string, s long")
    rows.select("id", "account", F.timestamp_seconds("s").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    origins = spark.createDataFrame([("1", "a", "same text", 1)], "id string, account string, text string, s long").select("id", "account", F.timestamp_seconds("s").alias("ts"), "text")
    found = copies_of(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), origins)
    stream = found.writeStream.format("memory").queryName("copies").option("checkpointLocation", str(tmp_path / "ck")).start()
    stream.processAllAvailable()
    stream.stop()
    assert [(r.origin_id, r.id) for r in spark.table("copies").collect()] == [("1", "2")]
