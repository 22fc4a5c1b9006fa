"""Rows parted by the keys that they are to meet, and what steps over clusters shuffle."""

from pyspark.sql import functions as F

from echotrace.operators import clusters, linking, screening, simjoin
from echotrace.session import temporary


def test_parts_are_all_rows_and_no_partner_is_lost(spark):
    rows = spark.createDataFrame([(i if i % 11 else None, f"k{i % 7}", i) for i in range(3000)], "a long, b string, n long")
    keys = rows.where("n % 5 = 0").select("a", "b")
    may, others = (df.collect() for df in screening.parted(rows, keys, "a", "b"))
    assert sorted(r.n for r in may + others) == list(range(3000))
    sure = {r.n for r in others}
    assert not [n for n in range(0, 3000, 5) if n in sure]
    assert len([r for r in may if r.a is not None]) <= 560
    found = screening.held(rows, keys, "a", "b")
    assert found.columns == rows.columns
    assert sorted(r.n for r in found.collect()) == [n for n in range(0, 3000, 5) if n % 11]  # a null key meets none
    none = screening.parted(rows, keys.where("false"), "a", "b")
    assert none[0].count() == 0 and none[1].count() == 3000


def shuffled(df, column):
    """Rows with `column` that the plan of `df`, once it has run, has shuffled."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name == "ShuffleQueryStageExec":
            todo.append(node.plan())
            continue
        if name == "BroadcastQueryStageExec":
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec" and any(node.output().apply(i).name() == column for i in range(node.output().size())):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return total


def test_texts_and_tokens_of_rows_without_a_partner_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the partners are too many to be broadcast
    try:
        with temporary(spark):
            posts = spark.range(4000).select(
                F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("a").alias("account"), F.lit("u").alias("url"), F.lit("t").alias("posted_at"), F.col("id").alias("posted_ms"), F.repeat(F.lit("x"), 40).alias("text")
            )
            members = posts.where("ord % 100 = 0").select("ord", F.lit("C-1").alias("cluster_id"), F.lit("a").alias("acct"))
            full = clusters.with_posts(members, posts)
            assert shuffled(full, "text") <= 50 and full.count() == 40
            sets = spark.range(4000).select(F.col("id").alias("ord"), F.lit("a").alias("acct"), F.lit("a").alias("last"), F.array(F.col("id"), F.col("id") + 1).alias("tokens"))
            comps = sets.where("ord % 100 = 0").select(F.col("ord").alias("node"), F.lit(0).cast("long").alias("component"))
            own = linking._with_components(sets, comps)
            assert shuffled(own, "tokens") <= 50
            assert {(r.ord, r.comp) for r in own.select("ord", "comp").collect()} == {(i, 0 if i % 100 == 0 else i) for i in range(4000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_classes_of_equal_sets_are_one_row_with_all_their_accounts(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], [10 * (i % 30), 1, 2]) for i in range(60)] + [(100 + i, "a", [7000 + i]) for i in range(200)] + [(400 + i, "z", [9, 8]) for i in range(3)]
    seen = []
    monkeypatch.setattr(clusters, "linked_sets", lambda sets, t: (seen.append(sets.collect()), linking.linked_sets(sets, t))[1])
    with temporary(spark):
        sets = spark.createDataFrame(rows, "ord long, acct string, tokens array<long>")
        found = clusters.approximate_members(sets, 0.9)
        clustered = {(r.ord, r.cluster_key, r.sim) for r in found.collect()}
    want = {}
    for o, a, t in rows:
        want.setdefault(tuple(t), []).append((o, a))
    assert {(r.ord, r.acct, r.last_acct, tuple(r.tokens)) for r in seen[0]} == {(min(o for o, _ in v), min(a for _, a in v), max(a for _, a in v), t) for t, v in want.items()}
    assert len(seen[0]) == len(want)
    assert clustered == {(o, min(v)[0], 1.0) for v in want.values() if len({a for _, a in v}) > 1 for o, _ in v}


def test_only_sets_of_pairs_meet_them(spark):
    rows = [(i, [i // 2 * 2, i // 2 * 2 + 1, -5]) for i in range(500)]
    with temporary(spark):
        sets = spark.createDataFrame(rows, "ord long, tokens array<long>")
        pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(20)], "a long, b long")
        assert sorted(simjoin.verified(pairs, sets, 0.9).select("a", "b").collect()) == [(2 * i, 2 * i + 1) for i in range(20)]
