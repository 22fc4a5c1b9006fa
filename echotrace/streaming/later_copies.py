"""Later copies over a stream of posts: an addition to the batch operators.

The batch operators look at a whole input. Here copies of a fixed set of origins are
found as posts arrive: the stream is joined with the origins on the key of the normalised
text, stateless, or with its own past within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.functions import text as T
from echotrace.options import DetectionOptions


def _keyed(posts: DataFrame, options: DetectionOptions) -> DataFrame:
    norm = T.normalize_text(F.col("text"), options.ignore_urls, options.ignore_mentions)
    return posts.withColumn("norm", norm).where("norm <> ''").withColumns({"acct": F.lower("account"), "k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit("key"), "norm")})


def copies_of(stream: DataFrame, origins: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:
    """Posts of `stream (id, account, ts, text)` that exactly copy an earlier post of `origins`."""
    o = _keyed(origins, options).select("k1", "k2", F.col("id").alias("origin_id"), F.col("acct").alias("origin_acct"), F.col("ts").alias("origin_ts"))
    s = _keyed(stream, options)
    return s.join(o, ["k1", "k2"]).where("acct <> origin_acct and ts > origin_ts").select("origin_id", "id", "account", "ts", "text")


def copies_within(stream: DataFrame, delay: str = "10 minutes", span: str = "1 hour", options: DetectionOptions = DetectionOptions()) -> DataFrame:
    """Pairs of posts of one stream, the later an exact copy of the earlier by another account within `span`.

    State is kept for `span` and `delay` of event time; posts later than `delay` are dropped.
    """
    own = _keyed(stream, options).select("k1", "k2", "id", "acct", "ts")
    side = lambda s: own.select(*(F.col(c).alias(f"{s}_{c}") for c in own.columns)).withWatermark(f"{s}_ts", delay)
    return side("o").join(
        side("c"), F.expr(f"o_k1 = c_k1 and o_k2 = c_k2 and o_acct <> c_acct and c_ts > o_ts and c_ts <= o_ts + interval {span}")
    ).select("o_id", "o_ts", "c_id", "c_ts")
