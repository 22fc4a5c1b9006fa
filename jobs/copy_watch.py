"""Watch a folder of posts for texts that several accounts post, taking only files that are new.

    python -m jobs.copy_watch --source POSTS --out OUT --checkpoint CHECKPOINT [--config FILE]

A file stream with a checkpoint takes the new files in micro-batches and stops when none is
left. Each batch is normalised once and written as narrow sightings (text keys, account, id,
time; no text) in a folder of its own number, which a repeated batch writes again in place:

    OUT/sightings/batch=N/bucket=B    posts by key of the normalised text; bucket -1: rejected, with a reason
    OUT/copies/bucket=B               a row for each text of two accounts or more and each account of it
    OUT/marks/bucket=B                the last batch that the bucket's copies have taken in

Then the copies of the buckets that have sightings beyond their mark are taken again, from
the sightings of these buckets alone, and replace the partitions of the same name; the marks
follow. A run that is lost at any point is made good by the next one: what a batch writes is
a function of the batch, and what a bucket's copies hold is a function of its sightings. A
run without new files writes nothing.

The source is a folder that files are added to, or a glob of files.

A post that comes again, in the same file or a later one, counts once: a post is an id with
a text and an account, at the earliest time given. The origin of a text is its earliest
post, by time and id, whenever it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import text as T
from jobs.common import arguments, config, known, log, mapped, read, session

SIGHTINGS = "k1 long, k2 long, account string, id string, posted_ms long, reason string, batch long, bucket int"
COPIES = (
    "text_posts long, text_accounts long, origin_id string, origin_account string, origin_ms long, account string, posts long, first_id string, first_ms long,"
    " delay_ms long, bucket int"
)
MARKS = "batch long, bucket int"
REJECTED = -1

# Reasons for a rejected post, the first that holds.
REASONS = ("id_required", "account_required", "posted_at_required", "text_empty")


def sightings(posts: DataFrame, settings: dict) -> DataFrame:
    """Narrow rows of `posts (id, account, posted_ms, text)` with their bucket; those that break a rule have a reason and no keys."""
    norm = T.normalize_text(F.col("text"), settings["ignore_urls"], settings["ignore_mentions"])
    own = posts.select(
        T.js_trim(F.col("id").cast("string")).alias("id"), F.lower(T.clean_account(F.col("account").cast("string"))).alias("account"),
        F.col("posted_ms").cast("long").alias("posted_ms"), F.coalesce(norm, F.lit("")).alias("norm"),
    )
    broken = (~T.required_text(F.col("id")), ~T.required_text(F.col("account")), F.col("posted_ms").isNull(), F.col("norm") == "")
    own = own.withColumn("reason", F.coalesce(*(F.when(b, F.lit(r)) for b, r in zip(broken, REASONS))))
    key = lambda *more: F.when(F.col("reason").isNull(), F.xxhash64(*more, "norm"))
    keyed = own.withColumns({"k1": key(), "k2": key(F.lit("key"))})
    bucket = F.coalesce(F.pmod("k1", F.lit(settings["buckets"])), F.lit(REJECTED)).cast("int")
    return keyed.select("k1", "k2", "account", "id", "posted_ms", "reason", bucket.alias("bucket"))


def copies(seen: DataFrame) -> DataFrame:
    """A row for each text of at least two accounts and each of its accounts, from valid sightings.

    Posts are summed up by account before a text's rows meet, so a text that a third of all
    posts repeat is as many rows as it has accounts.
    """
    posts = seen.groupBy("bucket", "k1", "k2", "account", "id").agg(F.min("posted_ms").alias("posted_ms"))
    first = F.min(F.struct("posted_ms", "id")).alias("first")
    accounts = posts.groupBy("bucket", "k1", "k2", "account").agg(F.count(F.lit(1)).alias("posts"), first)
    texts = accounts.groupBy("bucket", "k1", "k2").agg(
        F.sum("posts").alias("text_posts"), F.count(F.lit(1)).alias("text_accounts"), F.min(F.struct("first", "account")).alias("origin")
    ).where("text_accounts >= 2")
    both = accounts.join(texts, ["bucket", "k1", "k2"])
    return both.select(
        "text_posts", "text_accounts", F.col("origin.first.id").alias("origin_id"), F.col("origin.account").alias("origin_account"), F.col("origin.first.posted_ms").alias("origin_ms"),
        "account", "posts", F.col("first.id").alias("first_id"), F.col("first.posted_ms").alias("first_ms"), (F.col("first.posted_ms") - F.col("origin.first.posted_ms")).alias("delay_ms"), "bucket",
    )


def take_new(spark: SparkSession, source: str, out: str, checkpoint: str, settings: dict) -> int:
    """Write the sightings of all files that no run has taken; the number of batches that had some."""
    taken = []

    def take(batch: DataFrame, number: int) -> None:
        path = f"{out}/sightings/batch={number}"
        rows = sightings(mapped(batch, settings["columns"]), settings)
        salt = F.pmod(F.xxhash64("id"), F.lit(settings["files_a_bucket"]))  # a bucket with a very common text is several tasks
        rows.repartition("bucket", salt).write.mode("overwrite").partitionBy("bucket").parquet(path)
        taken.append(number)
        done = known(spark, path, SIGHTINGS).agg(F.count(F.lit(1)).alias("read"), F.count("reason").alias("rejected")).first()
        log.info("copy_watch: batch %d: read %d posts, rejected %d, wrote %s", number, done.read, done.rejected, path)

    schema = settings.get("schema") or read(spark, settings, source).schema
    stream = spark.readStream.format(settings.get("format", "parquet")).schema(schema).options(**settings.get("options", {}))
    stream = stream.option("maxFilesPerTrigger", settings["max_files_per_trigger"]).load(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(taken)


def refresh(spark: SparkSession, out: str, settings: dict) -> list[int]:
    """Take the copies of all buckets with sightings beyond their mark again; the buckets."""
    seen = known(spark, f"{out}/sightings", SIGHTINGS).where(F.col("bucket") != REJECTED)
    marks = known(spark, f"{out}/marks", MARKS).select("bucket", F.col("batch").alias("mark"))
    newest = seen.groupBy("bucket").agg(F.max("batch").alias("batch"))
    due = newest.join(marks, "bucket", "left").where("mark is null or batch > mark").select("batch", "bucket").collect()  # at most a row a bucket
    if not due:
        log.info("copy_watch: nothing new, nothing written")
        return []
    own = seen.where(F.col("bucket").isin([r.bucket for r in due]))  # partitions of other buckets are not read
    salt = F.pmod(F.xxhash64("account"), F.lit(settings["files_a_bucket"]))
    copies(own).repartition("bucket", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/copies")
    done = spark.createDataFrame(due, MARKS).coalesce(1)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/marks")
    buckets = sorted(r.bucket for r in due)
    log.info("copy_watch: took %d buckets again, their copies are %d rows", len(due), known(spark, f"{out}/copies", COPIES).where(F.col("bucket").isin(buckets)).count())
    return buckets


def run(spark: SparkSession, source: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Take what is new in `source`, bring the copies up to date, and return them all, read back."""
    settings = settings or config("copy_watch")
    take_new(spark, source, out, checkpoint, settings)
    refresh(spark, out, settings)
    return known(spark, f"{out}/copies", COPIES)


def main() -> None:
    own = arguments(__doc__, "source", "out", "checkpoint")
    spark = session("copy_watch")
    try:
        run(spark, own.source, own.out, own.checkpoint, config("copy_watch", own.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
