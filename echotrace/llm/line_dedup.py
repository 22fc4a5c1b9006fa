"""Line deduplication with keep bitmaps, in DataFrame functions only.

Hashes of line keys are range-partitioned by (hash, cell) and sorted within partitions by
(hash, cell, document, position). A cell is one of as many hash values of the document as
there are partitions, so a line that a third of all documents hold is spread over as many
partitions as its rows fill, and no group is larger than a cell of it. One pass over each
sorted partition streams the first document of every (hash, cell); rows of any later
document of it are dropped there and then. The rows of the first documents alone, at most
one document a cell, meet once more by hash, where all but the smallest document's are
dropped. No line key is aggregated, and no text is moved for it.

Texts of documents that lose lines meet their bitmaps by a shuffle join. All others stay
where they were read, but for those that a filter of one bit a hash takes for losers; it
has 8 MB at most, whatever the input, so that its misses grow where losers are many.

What comes back are not texts but, for each document that loses lines, a compressed keep
bitmap: 64-bit words, those of lines that all stay left out and counted as a skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.session import Scratch, cut

FILTER_BLOCKS = 2048  # of 32,768 bits, 4 KB: at most 8 MB are broadcast
BLOCK_BITS = 32_768  # fixed by the bitmap functions
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`(doc_id, text_hash, n_dropped, words)` of the documents that lose lines.

    A key of at least `min_chars` code points that at least two documents hold loses all
    its lines except in the smallest `doc_id` that holds it. `words (skip, word)` is the
    bitmap: `skip` words of ones, then `word`; line p stays if bit p % 64 of word p div 64
    is set, and words beyond the last one are all ones. Rows that repeat a `doc_id` are one
    holder; each row's own lines are marked, by `text_hash`. Rows with a null `doc_id` take
    no part.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _text(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").select(
        "doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keyed = own.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("cell"), "doc_id", "pos", "text_hash"
    )
    with Scratch(spark, "lines") as scratch:
        hashed = scratch.store(hashed, "hashed", narrow=False)  # range partitioning reads its input twice; texts are read once
        lines = hashed.repartitionByRange(parts, "h1", "h2", "cell").sortWithinPartitions("h1", "h2", "cell", "doc_id", "pos")
        streamed = Window.partitionBy("h1", "h2", "cell").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lines = scratch.store(lines.withColumn("later", F.col("doc_id") > F.first("doc_id").over(streamed)), "lines", narrow=False)
        firsts = lines.where("not later").drop("later")
        merged = firsts.withColumn("first_doc", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
        where = ("doc_id", "text_hash", "pos")
        dropped = lines.where("later").select(*where).unionByName(merged.where("doc_id > first_doc").select(*where))
        bits = (
            dropped.select("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
            .groupBy("doc_id", "text_hash", "word")
            .agg(F.bit_or("bit").alias("bits"))
            .groupBy("doc_id", "text_hash")
            .agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("held"))
        )
        words = F.expr("transform(held, (e, j) -> named_struct('skip', e.word - coalesce(get(held, j - 1).word, -1) - 1, 'word', ~e.bits))")
        return cut(bits.select("doc_id", "text_hash", "n_dropped", words.alias("words")))


def kept_text(text: str, words: str) -> Column:
    """The lines of column `text` whose bit in column `words` is set, joined by newlines."""
    lines = f"split({text}, '\\n', -1)"
    whole = f"flatten(transform({words}, w -> concat(array_repeat(-1L, w.skip), array(w.word))))"
    # the bitmap is unpacked once a row, as a field of a struct of its own
    stays = "coalesce(getbit(get(x.whole, cast(i div 64 as int)), i % 64), 1) = 1"
    return F.expr(f"array_join(transform(array(named_struct('lines', {lines}, 'whole', {whole})), x -> array_join(filter(x.lines, (line, i) -> {stays}), '\\n')), '')")


def _parted(docs: DataFrame, losers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` whose doc_id may be in the column of `losers`, and those whose doc_id surely is not.

    A null doc_id is among the latter.
    """
    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("loses"), key.cast("long")), F.lit(FILTER_BLOCKS * BLOCK_BITS))

    at = place(losers[losers.columns[0]])
    blocks = losers.select(F.floor(at / BLOCK_BITS).alias("block"), (at % BLOCK_BITS).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = place(docs["doc_id"])
    met = docs.join(F.broadcast(blocks), F.floor(at / BLOCK_BITS) == blocks["block"], "left")
    byte = F.conv(F.hex(F.substring(blocks["bits"], F.floor(at % BLOCK_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = docs["doc_id"].isNotNull() & F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    own = [docs[f"`{c}`"] for c in docs.columns]
    return met.where(may).select(*own), met.where(~may).select(*own)


def _n_lines(text: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`(doc_id, n_lines, n_dropped, words, kept_text)`, one row per row of `docs (doc_id, text, ...)`.

    A null or empty text is one empty line. `words` is null where nothing is dropped. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    maps = keep_bitmaps(docs, min_chars).withColumnsRenamed({"doc_id": "map_id", "text_hash": "map_hash"})
    some, others = _parted(_text(docs), maps.select("map_id"))
    found = some.join(maps.hint("shuffle_hash"), (some["doc_id"] == maps["map_id"]) & (F.xxhash64(some["text"]) == maps["map_hash"]), "left")
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(kept_text("text", "words"))
    found = found.select("doc_id", _n_lines("text").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "words", kept.alias("kept_text"))
    whole = others.select("doc_id", _n_lines("text").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast(maps.schema["words"].dataType).alias("words"), F.col("text").alias("kept_text"))
    return found.unionByName(whole)


def rewrite(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`docs` with duplicate lines taken out of `text`, all other columns and rows as they are.

    `n_chars`, if there, follows the text. A document that loses all its lines goes. Rows
    that lose no line stay as they are, null texts too. Other columns may have any names.
    """
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    words = own + "words"
    maps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias(own + "id"), F.col("text_hash").alias(own + "hash"), F.col("n_dropped").alias(own + "dropped"), F.col("words").alias(words))
    some, others = _parted(docs, maps.select(own + "id"))
    own_hash = F.xxhash64(F.coalesce(some["text"].cast("string"), F.lit("")))
    found = some.join(maps.hint("shuffle_hash"), (some["doc_id"] == maps[own + "id"]) & (own_hash == maps[own + "hash"]), "left")
    found = found.where(F.col(own + "dropped").isNull() | (F.col(own + "dropped") < _n_lines("text")))
    text = F.when(F.col(words).isNull(), F.col("text")).otherwise(kept_text("text", words))
    new = {"text": text} | ({"n_chars": F.when(F.col(words).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns)).unionByName(others)
