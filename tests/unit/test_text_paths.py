"""Texts of Latin-1 take a shorter way to their normal form and tokens; it must tell nothing apart from the general one."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from echotrace.functions import text as T

SPACE = "\t\n\x0b\f\r         　﻿"


def normal(s):
    out = unicodedata.normalize("NFKC", s).lower()
    out = re.sub("@[a-z0-9_]+", " ", re.sub(f"https?://[^{SPACE}]+", " ", out))
    return re.sub(f"[{SPACE}]+", " ", out).strip(" ")


def test_short_and_general_ways_agree(spark):
    rng = random.Random(8)
    latin = [chr(c) for c in range(1, 256)]
    more = list(SPACE) + ["東", "カ", "ー", "ſ", "Ā", "ﬁ", "①", "𠮷", "́", "http://a.b/ç", "@me_1", "  ", " \n", "\n ", "@", "https://"]
    texts = ["".join(rng.choice(latin + list(SPACE[:7]) * 6 if i % 2 else latin + more * 4) for _ in range(rng.randrange(0, 60))) for i in range(1500)] + ["", " ", "  ", "\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", "text", T.normalize_text(F.col("text")).alias("norm"))
    general = F.array_distinct(F.regexp_extract_all("norm", F.lit(T.TOKEN), 1))
    rows = df.select("*", T.tokens(F.col("norm")).alias("tokens"), F.when(~F.col("norm").rlike(f"[{T.JAPANESE}]"), general).alias("want")).collect()
    for r in rows:
        assert r.norm == (None if r.text is None else normal(r.text)), repr(r.text)
        assert r.want is None or r.tokens == r.want, repr(r.norm)
    assert sum(r.want is not None for r in rows) > 700
