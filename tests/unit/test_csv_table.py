"""The parallel CSV source against the one for small files."""

import random

import pytest

from echotrace.options import InputValidationError
from echotrace.session import temporary
from echotrace.sources import posts as S
from echotrace.sources.csv_table import scan_posts


def small(spark, content):
    try:
        return [tuple(r) for r in S.from_csv(spark, content).orderBy("ord").collect()]
    except InputValidationError as e:
        return e.args


def large(spark, path):
    try:
        with temporary(spark):
            return [tuple(r) for r in scan_posts(spark, path).orderBy("ord").collect()]
    except InputValidationError as e:
        return e.args


def cell(rng):
    s = "".join(rng.choices(["a", "é", "日", " ", ",", "\n", "\r", '"', "x\r\n"], k=rng.randrange(0, 9)))
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',\n"') or rng.random() < 0.3 else s


def table(rng, rows):
    out = [",".join(rng.sample(S.FIELDS, 5) + ["more"])]
    for _ in range(rows):
        out.append(rng.choice(["", " ,,,,,", ",".join(cell(rng) for _ in range(6))]) if rng.random() < 0.2 else ",".join(cell(rng) for _ in range(6)))
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n", "\r\n"])


BROKEN = [
    "", "a,b\n1,2\n", 'id,account,url,postedAt,text\n1,2,3,4,"open\nfor ever\n', 'id,account,url,postedAt,text\n1,2,3,4,5\n\n1,2,3,4,a"b"\n', "id,account,url,postedAt,text\n\n1,2,3,4,5\n ,\n1,2,3\n",
    '﻿"id",account,url,postedAt,text\n1,2,3,4,5\n', 'id,account,url,postedAt,text\n"a"b,"",3,4,"""q"""\n', "id,account,url,postedAt,text", 'id,id,account,url,postedAt,text\n1,2,3,4,5,6\n',
]


def test_small_tables_equal(spark, tmp_path):
    rng = random.Random(6)
    for i, content in enumerate(BROKEN + [table(rng, rng.randrange(1, 30)) for _ in range(6)]):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(content.encode())
        assert large(spark, str(path)) == small(spark, content.removeprefix("﻿")), content


def test_quoted_breaks_across_blocks(spark, tmp_path):
    rng = random.Random(7)
    content = table(rng, 900)
    path = tmp_path / "large.csv"
    path.write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
        assert large(spark, str(path)) == small(spark, content)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"id,account,url,postedAt,text\n1,2,3,4,\xff\n")
    with pytest.raises(InputValidationError, match="UTF-8"), temporary(spark):
        scan_posts(spark, str(tmp_path / "x.csv"))
