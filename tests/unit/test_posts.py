import json

import pytest
from pyspark.sql import functions as F

from echotrace.operators import clusters, latercopy, semantic
from echotrace.operators.validate import validate
from echotrace.options import DetectionOptions, InputValidationError
from echotrace.sinks import cluster_fragments, cluster_lines, copy_lines, evidence_document
from echotrace.sources import posts as S


def post(i, account, minute, text, **more):
    return {"id": str(i), "account": account, "url": f"https://sns.example/{account}/{i}", "postedAt": f"2026-01-01T00:{minute:02d}:00Z", "text": text} | more


def load(spark, *posts):
    return S.parse_input(spark, json.dumps(posts), "posts.JSON")


TEN = " ".join(f"word{i}" for i in range(10))


def clusters_of(spark, posts, **options):
    rows = clusters.find_duplicate_clusters(posts, DetectionOptions(**options)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.rank, r.position)):
        out.setdefault((r.cluster_id, r.match_type, r.similarity, r.account_count), []).append(r.id)
    return out


def test_exact_and_approximate_clusters(spark):
    posts = load(
        spark, post(1, "@a", 1, "Same ＴＥＸＴ https://x.example/1"), post(2, "b", 0, "same text @someone"), post(3, "A", 2, "alone"), post(4, "a", 3, "alone"),
        post(5, "c", 4, TEN + " mine"), post(6, "d", 5, TEN + " yours"), post(7, "e", 6, "@only https://only.example"), post(8, "f", 7, "@only"),
    )
    assert clusters_of(spark, posts) == {("C-001", "exact", 1.0, 2): ["2", "1"], ("C-002", "approximate", 0.83, 2): ["5", "6"]}
    assert clusters_of(spark, posts, approximate=False) == {("C-001", "exact", 1.0, 2): ["2", "1"]}
    assert list(clusters_of(spark, posts, threshold=0.9)) == [("C-001", "exact", 1.0, 2)]


def test_chains_and_bridges(spark):
    base = [f"t{i}" for i in range(20)]
    a, b, c = " ".join(base), " ".join(base[:-2] + ["x", "y"]), " ".join(base[:-4] + ["x", "y", "z", "w"])
    posts = load(spark, post(1, "p", 1, a), post(2, "q", 2, b), post(3, "r", 3, c))
    assert clusters_of(spark, posts) == {("C-001", "approximate", 0.82, 3): ["1", "2", "3"]}
    # equal texts of one account stay in and join through another account
    posts = load(spark, post(1, "p", 1, a), post(2, "p", 2, a), post(3, "q", 3, b))
    assert clusters_of(spark, posts) == {("C-001", "approximate", 0.82, 2): ["1", "2", "3"]}


def test_prefix_is_long_enough_at_the_threshold(spark):
    whole = " ".join(f"k{i:03d}" for i in range(100))
    part = " ".join(f"k{i:03d}" for i in range(45, 100))
    found = clusters_of(spark, load(spark, post(1, "p", 1, whole), post(2, "q", 2, part)), threshold=0.55)
    assert [k[2] for k in found] == [0.55]


def test_emoji_match_exactly_only(spark):
    posts = load(spark, post(1, "p", 1, "🎉🎉"), post(2, "q", 2, "🎉🎉"), post(3, "r", 3, "🎉🎊"))
    assert clusters_of(spark, posts) == {("C-001", "exact", 1.0, 2): ["1", "2"]}


def test_later_copies(spark):
    posts = load(
        spark, post(1, "alpha", 5, TEN + " mine"), post(2, "beta", 6, TEN + " mine"), post(3, "gamma", 7, TEN + " yours"), post(4, "beta", 5, TEN + " mine"), post(5, "ALPHA", 9, TEN + " mine"), post(6, "beta", 4, TEN + " mine"),
    )
    rows = latercopy.in_order(latercopy.find_later_copies(posts, account="@Alpha")).collect()
    assert [(r.o_id, r.c_id, r.match_type, r.similarity, r.time_difference_ms) for r in rows] == [("1", "2", "exact", 1.0, 60000), ("1", "3", "approximate", 0.83, 120000)]
    assert '"60","exact","1.00"' in copy_lines(latercopy.find_later_copies(posts, post_id="1")).orderBy("c_posted_ms").first().line
    for bad in ({}, {"post_id": "1", "account": "alpha"}):
        with pytest.raises(TypeError):
            latercopy.find_later_copies(posts, **bad)
    with pytest.raises(InputValidationError):
        latercopy.find_later_copies(posts, account="nobody")


def test_validation_tells_everything(spark):
    with pytest.raises(InputValidationError) as e:
        load(spark, post(1, "a", 1, "x", url="http://plain.example"), post(2, "", 1, " 　"), post(3, "b", 1, "y"), post(3, "c", 1, "z"))
    assert [m.split(": ")[1] for m in e.value.errors] == ["url_not_https", "account_required", "text_required", 'id_repeated "3"']
    assert validate(S.from_json(spark, "[]"))[0].count() == 0
    for name, content in (("x.txt", "[]"), ("x.json", "{"), ("x.json", '{"a": 1}'), ("x.json", "[]"), ("x.json", "[1]")):
        with pytest.raises(InputValidationError):
            S.parse_input(spark, content, name)
    with pytest.raises(InputValidationError):
        load(spark, *(post(i, "a", 1, "x") for i in range(5001)))
    with pytest.raises(InputValidationError):  # a number is no id
        load(spark, post(1, "a", 1, "x", id=5))


def test_csv(spark):
    head = "text,id,account,url,postedAt,more\r\n"
    row = '"a ""quoted""\nline",1,@a,https://x.example,2026-01-01T00:00:00+0900,z\r\n'
    got = S.parse_input(spark, head + row + "\r\n, ,,,,\r\n", "p.csv").collect()
    assert [(r.id, r.account, r.text, r.posted_ms) for r in got] == [("1", "a", 'a "quoted"\nline', 1767193200000)]
    for bad in ("", "id,account\n", head + "a,1\n", head + 'a"b,1,a,https://x.example,2026-01-01T00:00:00Z,\n', head + '"open'):
        with pytest.raises(InputValidationError):
            S.parse_input(spark, bad, "p.csv")


def test_api_export(spark):
    export = {
        "data": [{"id": "9", "author_id": "u1", "created_at": "2026-01-01T00:00:00.000Z", "text": "hi"}],
        "includes": {"users": [{"id": "u1", "username": "old"}, {"id": "u1", "username": "@a b!"}, None]},
    }
    got = S.parse_input(spark, json.dumps(export), "x.json").collect()
    assert [(r.account, r.url) for r in got] == [("a b!", "https://x.com/a%20b!/status/9")]
    export["data"].append({"id": "10", "author_id": "nobody", "created_at": "", "text": ""})
    with pytest.raises(InputValidationError) as e:
        S.parse_input(spark, json.dumps(export), "x.json")
    assert [m.split(": ")[1] for m in e.value.errors] == ["author_unknown", "created_at_required", "text_required"]
    for broken in ({"data": []}, {"data": 1, "includes": {"users": []}}):
        with pytest.raises(InputValidationError):
            S.parse_input(spark, json.dumps(broken), "x.json")


def judged(spark, *rows):
    return spark.createDataFrame([(None, c, status, label, score, None, model, None, None, None) for c, status, label, score, model in rows], semantic.JUDGMENT)


def test_candidates_and_reconciliation(spark):
    posts = load(spark, post(1, "a", 1, TEN + " mine"), post(2, "b", 2, TEN + " yours"), post(3, "c", 3, "quite another thing"), post(4, "c", 4, "and one more"), post(5, "d", 5, "last words here"))
    members = clusters.find_duplicate_clusters(posts)
    found = semantic.create_candidates(posts, members)
    got = {r.candidate_id: (r.lexical, r.discovery, r.lexical_similarity) for r in found.collect()}
    assert got == {"semantic:1:2": (True, True, 0.83), "semantic:2:3": (False, True, None), "semantic:4:5": (False, True, None)}
    assert [r.candidate_id for r in semantic.review(found, 2).collect()] == ["semantic:1:2", "semantic:2:3"]
    told = judged(spark, ("semantic:1:2", "completed", "non_match", 0.1, "m"), ("semantic:4:5", "completed", "match", 0.9, "m"))
    after, table, decisions = semantic.reconcile(posts, members, found, told)
    assert [(r.cluster_id, r.similarity, r.post_count) for r in table.collect()] == [("C-001", 0.9, 2)]
    assert sorted(r.id for r in after.collect()) == ["4", "5"]
    summary = semantic.cluster_summary(after, decisions).collect()
    assert [(r.completed, r.matches, r.highest_score, r.resolved_models) for r in summary] == [(1, 1, 0.9, ["m"])]
    totals = semantic.run_summary(found.agg(F.count(F.lit(1)).alias("total")), told, decisions).first()
    assert (totals.total, totals.reviewed, totals.skipped, totals.added_by_semantic, totals.excluded_by_semantic) == (3, 2, 1, 1, 1)
    # an abstaining judge keeps the pair and raises its score
    _, table, _ = semantic.reconcile(posts, members, found, judged(spark, ("semantic:1:2", "completed", "abstain", 0.95, "")))
    assert [(r.similarity, r.post_count) for r in table.collect()] == [(0.95, 2)]


def test_judge(spark):
    rows = spark.createDataFrame([("c1", "left", "right"), ("c2", "left", "fail")], "candidate_id string, leftText string, rightText string")

    def judge(request):
        if request["right"] == "fail":
            raise RuntimeError("down")
        return {"label": "match", "score": 0.75, "resolvedModel": "m"}

    got = {r.candidateId: (r.status, r.label, r.score) for r in semantic.judge_candidates(rows, judge).collect()}
    assert got == {"c1": ("completed", "match", 0.75), "c2": ("unavailable", "abstain", 0.0)}
    with pytest.raises(ValueError):
        semantic.judge_candidates(spark.createDataFrame([("c", "x" * 4001, "y")], rows.schema), judge)


def test_sinks(spark, tmp_path):
    posts = load(spark, post(1, "a", 1, '<b>"=1"</b>'), post(2, "=beta", 2, '<b>"=1"</b>'))
    members = clusters.find_duplicate_clusters(posts)
    lines = [r.line for r in cluster_lines(members).orderBy("rank", "position").collect()]
    assert lines[1].split(",")[5] == "\"'=beta\"" and lines[0].endswith('"<b>""=1""</b>"')
    from echotrace.sinks import CLUSTER_COLUMNS, write_lines

    assert write_lines(cluster_lines(members), CLUSTER_COLUMNS, str(tmp_path / "out"), "rank", "position")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert text.startswith('"clusterId","matchType"') and text.endswith("\r\n") and text.count("\r\n") == 3
    assert not write_lines(cluster_lines(members.where("false")), CLUSTER_COLUMNS, str(tmp_path / "none"))
    page = evidence_document([r.fragment for r in cluster_fragments(members).orderBy("rank").collect()], {"threshold": "0.80"})
    assert "&lt;b&gt;&quot;=1&quot;&lt;/b&gt;" in page and "<b>" not in page and "検出クラスタ: 1件" in page
    with pytest.raises(TypeError):
        evidence_document("x", {})
