"""The jobs on copies of small tables: growing input, repeated and interrupted runs."""

import json
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

from jobs import copy_watch, detection_report
from jobs.common import config

POST = "id string, account string, ms long, text string"
SETTINGS = config("copy_watch") | {"columns": {"id": "id", "account": "account", "posted_ms": "ms", "text": "text"}, "buckets": 4, "max_files_per_trigger": 2}


def posts(seed, n, start):
    rng = random.Random(seed)
    texts = [f"Text number {i} https://a.example/{rng.random()}" for i in range(12)] + ["", None, "@only https://x.example", "ＡＢＣ", "abc"]
    return [(None if rng.random() < 0.03 else str(start + i), rng.choice(["@Ann", "ann", "bob", "Cy", "", None]), rng.choice([None, *range(40)]), rng.choice(texts)) for i in range(n)]


def expected(rows):
    by = defaultdict(lambda: defaultdict(dict))
    for i, account, ms, text in rows:
        account = (account or "").lstrip("@").lower()
        norm = {"ＡＢＣ": "abc"}.get(text, (text or "").lower()).partition("https")[0].replace("@only", "").strip()
        if i and account and ms is not None and norm:
            own = by[norm][account]
            own[i] = min(own.get(i, ms), ms)
    out = []
    for accounts in by.values():
        firsts = {a: min((ms, i) for i, ms in own.items()) for a, own in accounts.items()}
        (ms, i), account = min((f, a) for a, f in firsts.items())
        if len(accounts) > 1:
            out += [(sum(map(len, accounts.values())), len(accounts), i, account, ms, a, len(own), firsts[a][1], firsts[a][0], firsts[a][0] - ms) for a, own in accounts.items()]
    return sorted(out)


def found(df):
    return sorted(tuple(r)[:-1] for r in df.collect())


def add(spark, folder, rows, files=2):
    spark.createDataFrame(rows, POST).repartition(files).write.mode("append").parquet(folder)


def state(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


def test_copy_watch_takes_only_what_is_new(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("posts", "out", "checkpoint"))
    first, second = posts(1, 150, 0), posts(2, 150, 1000)
    add(spark, source, first, 3)
    assert found(copy_watch.run(spark, source, out, checkpoint, SETTINGS)) == expected(first)
    before = state(f"{out}/sightings")
    add(spark, source, second + first[:20])  # some posts come again
    assert found(copy_watch.run(spark, source, out, checkpoint, SETTINGS)) == expected(first + second)
    assert {k: v for k, v in state(f"{out}/sightings").items() if k in before} == before  # older batches were not taken again
    rejected = spark.read.schema(copy_watch.SIGHTINGS).parquet(f"{out}/sightings").where("bucket = -1")
    assert {r.reason for r in rejected.select("reason").distinct().collect()} == set(copy_watch.REASONS)
    assert spark.read.parquet(f"{out}/sightings").count() == len(first) + len(second) + 20

    before = state(out)
    assert found(copy_watch.run(spark, source, out, checkpoint, SETTINGS)) == expected(first + second)
    assert state(out) == before  # nothing new, nothing written


def test_copy_watch_makes_good_a_lost_run(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("posts", "out", "checkpoint"))
    rows = posts(3, 120, 0)
    add(spark, source, rows, 4)
    copy_watch.take_new(spark, source, out, checkpoint, SETTINGS)  # lost before the copies
    assert found(copy_watch.run(spark, source, out, checkpoint, SETTINGS)) == expected(rows)
    last = max(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # lost after a batch's sightings were written and before it was committed
    for extra in Path(checkpoint, "commits").glob(f".{last.name}.crc"):
        extra.unlink()
    assert found(copy_watch.run(spark, source, out, checkpoint, SETTINGS)) == expected(rows)
    assert spark.read.parquet(f"{out}/sightings").count() == len(rows)
    # only the buckets that new posts fall into are taken again
    add(spark, source, [("9001", "zed", 1, "Text number 3"), ("9002", "bob", 2, "text NUMBER 3")], 1)
    copy_watch.take_new(spark, source, out, checkpoint, SETTINGS)
    assert len(copy_watch.refresh(spark, out, SETTINGS)) == 1


def test_copy_watch_of_an_empty_folder(spark, tmp_path):
    source = str(tmp_path / "posts")
    spark.createDataFrame([], POST).write.parquet(source)
    assert copy_watch.run(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), SETTINGS).count() == 0


@pytest.mark.parametrize("form", ["json", "csv"])
def test_copy_watch_of_other_formats(spark, tmp_path, form):
    source = str(tmp_path / "posts")
    rows = [("1", "ann", 5, "one text, \"quoted\""), ("2", "bob", 4, "One text, \"quoted\"")]
    spark.createDataFrame(rows, POST).write.option("header", True).format(form).save(source)
    own = SETTINGS | {"format": form, "schema": POST, "options": {"header": "true", "escape": "\\"}}
    assert found(copy_watch.run(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), own)) == expected(rows)


REPORT = config("detection_report") | {
    "columns": {"ord": "ord", "id": "id", "account": "account", "url": "url", "postedAt": "at", "text": "text"}, "takedowns": {"columns": {"id": "id"}}
}
RAW = "ord long, id string, account string, url string, at string, text string"


def raw(n, text):
    return [(i, str(i), f"@u{i}", "https://a.example/x", f"2024-01-01T00:{i % 60:02d}:00Z", text) for i in range(n)]


def test_detection_report_is_replaced_by_its_label(spark, tmp_path):
    src, gone, out = (str(tmp_path / x) for x in ("posts", "gone", "out"))
    bad = [(50, "", "a" * 31, "http://a.example", "yesterday", " "), (51, "1", "v", "https://a.example", "2024-01-01T00:00:00Z", "the id again")]
    near = [(60 + i, f"n{i}", f"v{i}", "https://a.example/y", "2024-01-01T01:00:00+09:00", f"one two three four five six seven eight nine ten own{i}") for i in range(3)]
    spark.createDataFrame(raw(5, "a text") + bad + near, RAW).write.parquet(src)
    spark.createDataFrame([("4",), ("4",), ("none",), (None,)], "id string").write.parquet(gone)
    for _ in range(2):
        t = detection_report.run(spark, src, out, "one", gone, REPORT)
    assert [(r.cluster_id, r.match_type, r.similarity, r.account_count, r.post_count, r.first_id) for r in t["clusters"].orderBy("rank").collect()] == [
        ("C-001", "exact", 1.0, 4, 4, "0"), ("C-002", "approximate", 0.83, 3, 3, "n0")]
    assert [r.id for r in t["members"].orderBy("rank", "position").collect()] == ["0", "1", "2", "3", "n0", "n1", "n2"]
    assert sorted((r.ord, r.rule) for r in t["rejected"].collect()) == sorted([(50, x) for x in ("id_required", "account_too_long", "url_not_https", "posted_at_not_iso", "text_required")] + [(51, "id_repeated")])
    assert {(r.edge_type, r.evidence_count) for r in t["edges"].collect()} == {("exact", 1), ("approximate", 1)} and t["edges"].count() == 9
    assert t["lines"].count() == 7 and t["lines"].orderBy("rank", "position").first().line.startswith('"C-001","exact","1.00","4","4","u0"')
    other = detection_report.run(spark, src, out, "two", None, REPORT | {"approximate": False})
    assert other["clusters"].count() == 1 and other["clusters"].first().post_count == 5
    # the label's next run has no exact cluster left; its partition goes, the other label's stays
    src2 = str(tmp_path / "fewer")
    spark.createDataFrame(near, RAW).write.parquet(src2)
    t = detection_report.run(spark, src2, out, "one", gone, REPORT)
    assert [r.match_type for r in t["clusters"].collect()] == ["approximate"] and t["rejected"].count() == 0
    assert spark.read.parquet(f"{out}/members").where("run = 'two'").count() == 5 and spark.read.parquet(f"{out}/members").where("run = 'one' and match_type = 'exact'").count() == 0


def test_detection_report_of_no_posts(spark, tmp_path):
    src = str(tmp_path / "posts")
    spark.createDataFrame([], RAW).write.parquet(src)
    t = detection_report.run(spark, src, str(tmp_path / "out"), "one", None, REPORT)
    assert all(df.count() == 0 for df in t.values())


def test_command_line(spark, tmp_path):
    """The command line makes a session of its own, runs, logs and stops."""
    add(spark, str(tmp_path / "posts"), posts(5, 40, 0))
    (tmp_path / "own.json").write_text(json.dumps({"columns": SETTINGS["columns"], "buckets": 2}))
    command = [sys.executable, "-m", "jobs.copy_watch", *(x for a in ("source", "out", "checkpoint") for x in (f"--{a}", str(tmp_path / {"source": "posts"}.get(a, a)))), "--config", str(tmp_path / "own.json")]
    ran = subprocess.run(command, cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "read 40 posts" in ran.stderr and found(spark.read.schema(copy_watch.COPIES).parquet(str(tmp_path / "out/copies"))) == expected(posts(5, 40, 0))
