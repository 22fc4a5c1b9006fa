"""The pipeline stage by stage against plain restatements, on the smallest tables."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None, "en", "s", None), (10_001, "12 34", "en", "s", 5)], docs.schema))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language ID":
            assert set(before) - set(after) == {10_000, 10_001}
        elif name == "line dedup":
            want = brute.dedup_lines(list(before.items()))
            gone = {i for i, (n, dropped, _) in want.items() if n == dropped}
            assert set(after) == set(before) - gone
            hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
            assert all(hashed[i] == want[i][2] for i in after)
        elif name == "MinHash near-dedup":
            want = brute.near_duplicates(list(before.items()), 5)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif name == "benchmark decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            held = {i for i, t in before.items() if any(x in " ".join((t or "").lower().split()) for x in items)}
            assert held <= set(before) - set(after) and len(set(before) - set(after)) <= len(held) + 2
        else:
            assert set(after) == set(before) and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, DIR).columns == docs.columns


def test_rows_of_one_id_stay_or_go_by_their_text(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if r.text)
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    clean = corpus_pipeline.decontaminate(spark, corpus_pipeline.identify_language(spark, docs, DIR), DIR).where("length(text) > 200").orderBy("doc_id").first()
    more = spark.createDataFrame([(20_000, clean.text, "en", "s", 1), (20_000, "12 34", "en", "s", 1), (20_000, None, "en", "s", 1), (20_001, clean.text, "en", "s", 1), (20_001, f"{item} {item}", "en", "s", 1)], schema)
    docs = docs.select(*schema.names).unionByName(more)
    texts = lambda df, i: [r.text for r in df.where(F.col("doc_id") == i).collect()]
    assert texts(corpus_pipeline.identify_language(spark, docs, DIR), 20_000) == [clean.text]
    assert texts(corpus_pipeline.decontaminate(spark, docs, DIR), 20_001) == [clean.text]


def test_stages_take_empty_tables_and_busy_names(spark):
    """Ties, repeated rows, a very long text, and columns named as those that stages make."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    long = " ".join(r.text for r in docs.where("lang = 'en' and length(text) > 200").orderBy("doc_id").limit(200).collect())
    some = docs.select("doc_id", "text", "lang", "source").where("doc_id < 60")
    more = spark.createDataFrame([(30_000, long, "en", "s"), (30_000, long, "en", "s"), (30_001, None, None, None), (None, None, None, None)], some.schema)
    some = some.unionByName(more).withColumns({c: F.lit(1) for c in ("gone_id", "__map_id", "__words", "__dropped", "n_dropped", "words", "text_hash")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, some, DIR)
        assert found.columns == some.columns, name
        rows = found.where("doc_id >= 30000 or doc_id is null").groupBy("doc_id").count().collect()
        count = {r.doc_id: r["count"] for r in rows}
        assert count.get(30_000, 0) in (0, 2), name  # repeated rows stay or go together
        assert (count.get(30_000) == 2 and count.keys() == {30_000}) if name == "language ID" else count.keys() >= {30_001, None}, name
        assert stage(spark, some.where("false"), DIR).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, some.where("false"), DIR).count() == 0
