"""Posts from CSV and JSON files, nested API exports and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import text as T
from echotrace.operators.validate import checked_posts
from echotrace.options import InputValidationError

RAW = "ord long, id string, account string, url string, postedAt string, text string"
FIELDS = ("id", "account", "url", "postedAt", "text")


def scan_utf8(spark: SparkSession, path: str) -> DataFrame:
    """`(path, text)` of files, without a byte order mark; the text is null where the bytes are no UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.regexp_replace(text, "^\ufeff", "").alias("text"))


def read_utf8(spark: SparkSession, path: str) -> str:
    """The text of one file, see `scan_utf8`; bytes that are no UTF-8 are an error."""
    row = scan_utf8(spark, path).first()
    if row is None or row["text"] is None:
        raise InputValidationError(["the file is not valid UTF-8"])
    return row["text"]


def split_csv(content: str) -> list[list[str]]:
    """Rows of a CSV text: doubled quotes, quoted line breaks; a carriage return outside quotes counts for nothing.

    A quote inside an unquoted field and a quote without end are errors.
    """
    if not content:
        raise InputValidationError(["the CSV file is empty"])
    rows: list[list[str]] = [[]]
    at, end = 0, len(content)
    while True:
        field = ""
        while at < end and content[at] not in ",\n":
            if content[at] == '"':
                if field:
                    raise InputValidationError([f"CSV row {len(rows)}: a quote inside a field"])
                close = at + 1
                while (close := content.find('"', close)) >= 0 and content[close + 1 : close + 2] == '"':
                    close += 2
                if close < 0:
                    raise InputValidationError(["CSV: a quote has no end"])
                field, at = field + content[at + 1 : close].replace('""', '"'), close + 1
            else:
                field += content[at] if content[at] != "\r" else ""
                at += 1
        rows[-1].append(field)
        if at >= end:
            break
        if content[at] == "\n":
            rows.append([])
        at += 1
    if rows[-1] == [""] and len(rows) > 1:
        rows.pop()
    return rows


def from_csv(spark: SparkSession, content: str) -> DataFrame:
    """Raw posts of a CSV text with a header that names at least the five fields, in any order."""
    header, *rows = split_csv(content)
    if not set(FIELDS) <= set(header):
        raise InputValidationError([f"the CSV header needs {', '.join(FIELDS)}"])
    at = {name: i for i, name in enumerate(header)}  # of a repeated name the last counts
    blank = "\t\n\r\v\f \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
    rows = [r for r in rows if any(v.strip(blank) for v in r)]
    for i, r in enumerate(rows):
        if len(r) != len(header):
            raise InputValidationError([f"CSV row {i + 2}: it does not have as many fields as the header"])
    return spark.createDataFrame([(i, *(r[at[f]] for f in FIELDS)) for i, r in enumerate(rows)], RAW)


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts of large, well-formed CSV files by Spark's own reader, in any order of columns and with others beside them.

    `ord` rises within each file's rows, and rows of another width than the header's fail
    the query that reads them.
    """
    own = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", inferSchema=False)
    if not set(FIELDS) <= set(own.columns):
        raise InputValidationError([f"the CSV header needs {', '.join(FIELDS)}"])
    return own.select(F.monotonically_increasing_id().alias("ord"), *FIELDS)


def from_json(spark: SparkSession, content: str) -> DataFrame:
    """Raw posts of a JSON text: an array, an object with `posts`, or an API export with `data`.

    Values that are no strings become null, so a number is not taken for an id.
    """
    import json

    try:
        parsed = json.loads(content)
    except ValueError:
        raise InputValidationError(["the file is not valid JSON"]) from None
    if isinstance(parsed, dict) and isinstance(parsed.get("posts"), list):
        parsed = parsed["posts"]
    elif isinstance(parsed, dict) and "data" in parsed:
        return from_api_export(spark, parsed)
    if not isinstance(parsed, list):
        raise InputValidationError(["posts must be an array"])
    wrong = [f"row {i + 1}: a post must be an object" for i, p in enumerate(parsed) if not isinstance(p, dict)]
    if wrong:
        raise InputValidationError(wrong)
    text = lambda v: v if isinstance(v, str) else None
    return spark.createDataFrame([(i, *(text(p.get(f)) for f in FIELDS)) for i, p in enumerate(parsed)], RAW)


def posts_of_json(files: DataFrame, key: str) -> DataFrame:
    """`(key, ord, ...FIELDS)` of JSON documents `(key, content)`, each an array of posts or an object with `posts`, in parallel.

    Values that are no strings become null, posts that are no objects have none, and a
    document that is not of either form gives no rows.
    """
    document = files.select(key, F.try_parse_json("content").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.posts", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    posts = document.select(key, F.posexplode(listed).alias("ord", "p"))
    text = lambda f: F.when(F.schema_of_variant(F.try_variant_get("p", f"$.{f}", "variant")) == "STRING", F.try_variant_get("p", f"$.{f}", "string")).alias(f)
    return posts.select(key, F.col("ord").cast("long").alias("ord"), *(text(f) for f in FIELDS))


def from_api_export(spark: SparkSession, payload: dict) -> DataFrame:
    """Raw posts of `{data: [...], includes: {users: [...]}}`; all errors are told together."""
    if not isinstance(payload.get("data"), list):
        raise InputValidationError(["API export: data must be an array"])
    includes = payload.get("includes")
    if not isinstance(includes, dict) or not isinstance(includes.get("users"), list):
        raise InputValidationError(["API export: includes.users must be an array"])
    text = lambda v: v if isinstance(v, str) else None
    data = [(i, isinstance(p, dict), *(text(p.get(f)) if isinstance(p, dict) else None for f in ("id", "author_id", "created_at", "text"))) for i, p in enumerate(payload["data"])]
    users = [(i, text(u.get("id")), text(u.get("username"))) for i, u in enumerate(includes["users"]) if isinstance(u, dict)]
    posts = spark.createDataFrame(data, "ord long, is_object boolean, id string, author_id string, created_at string, text string")
    named = spark.createDataFrame(users, "pos long, id string, username string")
    raw, errors = join_authors(posts, named)
    told = [r["message"] for r in errors.orderBy("ord", "at").collect()]
    if told:
        raise InputValidationError(told)
    return raw


def usernames(users: DataFrame) -> DataFrame:
    """`(author_key, account)` of `users (pos, id, username)`; of a repeated id the last user counts."""
    own = users.select("pos", T.js_trim(F.col("id")).alias("author_key"), T.clean_account(F.col("username")).alias("account"))
    return own.where("author_key <> '' and account <> ''").groupBy("author_key").agg(F.max_by("account", "pos").alias("account"))


def join_authors(posts: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(raw posts, errors)` of exported `posts (ord, is_object, id, author_id, created_at, text)` and their users."""
    own = posts.withColumns({c: T.js_trim(F.coalesce(c, F.lit(""))) for c in ("id", "author_id", "created_at")})
    both = own.join(usernames(users), F.col("author_id") == F.col("author_key"), "left")
    missing = {
        "not_an_object": ~F.col("is_object"), "id_required": F.col("id") == "", "author_required": F.col("author_id") == "",
        "author_unknown": (F.col("author_id") != "") & F.col("account").isNull(), "created_at_required": F.col("created_at") == "", "text_required": ~T.required_text(F.col("text")),
    }
    rules = F.array(*(F.when(c if k == "not_an_object" else F.col("is_object") & c, F.lit(k)) for k, c in missing.items()))
    errors = both.select("ord", F.posexplode(rules).alias("at", "rule")).where("rule is not null")
    errors = errors.withColumn("message", F.concat(F.lit("data["), (F.col("ord") + 1).cast("string"), F.lit("]: "), "rule"))
    url = F.concat(F.lit("https://x.com/"), T.encode_uri_component(F.col("account")), F.lit("/status/"), T.encode_uri_component(F.col("id")))
    good = both.where("id <> '' and account is not null")
    return good.select("ord", "id", "account", url.alias("url"), F.col("created_at").alias("postedAt"), "text"), errors


def parse_input(spark: SparkSession, content: str, file_name: str) -> DataFrame:
    """Checked posts of a file's text, by the suffix of its name."""
    name = (file_name or "").lower()
    if name.endswith(".json"):
        return checked_posts(from_json(spark, content))
    if name.endswith(".csv"):
        return checked_posts(from_csv(spark, content))
    raise InputValidationError(["the input must be a .csv or .json file"])


CASES = "version string, purpose string, cases array<struct<id: string, category: string, leftText: string, rightText: string, expectedLabel: string>>"


def cases_of(files: DataFrame) -> DataFrame:
    """Cases `(id, category, leftText, rightText, expectedLabel)` of parsed evaluation files `(cases)`."""
    return files.select(F.explode("cases").alias("c")).select("c.*")


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation file."""
    return cases_of(spark.read.schema(CASES).json(path, multiLine=True))


def _generated(spark: SparkSession, size: int, text) -> DataFrame:
    account = F.concat(F.lit("account_"), (F.col("ord") % 200).cast("string"))
    n = (F.col("ord") + 1).cast("string")
    ms = F.lit(1767225600000) + F.col("ord") % 60 * 1000
    return spark.range(size).withColumnRenamed("id", "ord").select(
        "ord", F.concat(F.lit("benchmark-"), n).alias("id"), account.alias("account"), F.concat(F.lit("https://x.com/"), account, F.lit("/status/"), n).alias("url"),
        F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"), ms.alias("posted_ms"), text.alias("text"),
    )


def exact_benchmark_posts(spark: SparkSession, size: int) -> DataFrame:
    """Posts of which each ten in a row have the same text."""
    return _generated(spark, size, F.concat(F.lit("exact benchmark group "), F.expr("ord div 10").cast("string")))


def approximate_benchmark_posts(spark: SparkSession, size: int) -> DataFrame:
    """Posts of which each fifty in a row share ten words and have one of their own."""
    shared = F.concat_ws(" ", *(F.concat(F.lit("topic"), F.expr("ord div 50").cast("string"), F.lit(f"_{i}")) for i in range(10)))
    return _generated(spark, size, F.concat(shared, F.lit(" unique_"), F.col("ord").cast("string")))
