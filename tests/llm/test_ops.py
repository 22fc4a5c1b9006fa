"""Each operator on odd rows, against plain restatements."""

import fractions
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echotrace.llm import fast_encode, hilbert, langid, line_dedup, lsa, packing, queries, token_counts, topk, toxicity, wavelet

DOC = "doc_id long, text string"
ODD = [
    "it's 12,5% ok  \n\n  x\ty ", "<|endoftext|> a", "日本語 text", "naïve café’s “quotes” …", "a b", "İstanbul ŉ", "é", "", "   ", "\n", "x" * 5000,
    "½ ²³ ºª µ", "DON'T 'RE re'll 'x'", "ß ẞ", "a\x85b", "٣", "don’t", "a <|startoftext|> b", "🎉" * 30,
]


def odd_docs(spark):
    """Null, empty, repeated and very long texts; null and repeated ids; extra columns with busy names."""
    rng = random.Random(3)
    long = "\n".join(" ".join(f"word{rng.randrange(900)}" for _ in range(12)) for _ in range(6000))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "a line of text\nother"), (52, "A Line of Text \nmore"), (53, long), (54, long), (55, "same"), (55, "same"), (None, "no id at all")]
    return rows, spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("key", "part", "n", "id", "shard", "place", "length", "words", "text_hash", "lang", "source")})


def ids(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_line_dedup(spark):
    rows, docs = odd_docs(spark)
    docs = docs.where("doc_id is not null")
    rows = [r for r in rows if r[0] is not None]
    found = line_dedup.dedup_lines(docs).withColumn("h", F.sha2("kept_text", 256)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.h) for r in found} == brute.dedup_lines(rows)
    for r in found:
        words = [x for w in r.words or [] for x in [-1] * w.skip + [w.word]]
        kept = sum(1 for i in range(r.n_lines) if i // 64 >= len(words) or words[i // 64] >> (i % 64) & 1)
        assert kept == r.n_lines - r.n_dropped
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0
    new = line_dedup.rewrite(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert new.where("doc_id = 54").count() == 0 and new.where("doc_id = 52").first().text == "more" and new.where("doc_id = 52").first().n_chars == 4


def test_line_dedup_streams_sorted_ranges(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice(["a line that all share", f"own line {i} {j}", f"some share this {rng.randrange(40)}", "short"]) for j in range(rng.randrange(1, 200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("cell", "later", "held", "word", "first_doc")})
    found = line_dedup.dedup_lines(docs).withColumn("h", F.sha2("kept_text", 256))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.h) for r in found.collect()} == brute.dedup_lines(rows)
    maps = line_dedup.keep_bitmaps(docs)
    assert all(w.word != -1 for r in maps.collect() for w in r.words)  # words of ones take no room


def test_line_dedup_rewrites_beside_busy_names(spark):
    rows = [(1, "a line of text\nmine"), (2, "A line of text\nown too"), (3, "nothing shared here"), (None, "a line of text"), (4, None), (5, "a line of text")]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("__id", "__words", "___hash", "__dropped", "block", "bits", "a.b", "map_id")})
    new = line_dedup.rewrite(docs)
    assert new.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in new.collect()) == [(0, "a line of text"), (1, "a line of text\nmine"), (2, "own too"), (3, "nothing shared here"), (4, "")]
    assert line_dedup.rewrite(docs.where("false")).count() == 0


def test_line_dedup_leaves_other_texts_in_place(spark):
    """Only rows that the filter lets through are shuffled with their texts; it never misses a loser."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], DOC)
    some, others = line_dedup._parted(docs, docs.where("doc_id % 7 = 0").select("doc_id"))
    some, others = {r.doc_id for r in some.collect()}, {r.doc_id for r in others.collect()}
    assert some | others == set(range(3000)) and not some & others
    assert {i for i in range(3000) if i % 7 == 0} <= some and len(some) < 3000 // 7 + 20


def test_line_dedup_without_id(spark):
    docs = spark.createDataFrame([(None, "a line of text"), (1, "a line of text"), (None, None)], DOC)
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(docs).collect()) == [0, 0, 0]


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(1)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "zorkan", "zorkit", "zorkul", "zorkem", "mucky"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "zorkix")], DOC).withColumn("score", F.lit("x"))
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (7777, 1)], "doc_id long, toxic int"), ~langid.held_out(3, 1))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(dict(labels)[i]) for i in held)
    assert right / len(held) > 0.98 and got[5000] < 0.7 and got[5000] == got[5001] and got[None] >= 0.7
    assert all(0 <= s <= 1 for s in got.values())
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.score < 0.7 for r in toxicity.score(docs, empty).collect()} == {True}


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.93, y, ~y) for _ in range(3)]
    noise = rng.random(4000) < 0.5
    votes = np.stack([*good, noise, noise, noise], axis=1) * 2.0 - 1  # three voters that are one
    given = np.where(rng.random(4000) < 0.9, y, ~y)
    post = toxicity.label_model(votes, given.astype(float))
    assert ((post > 0.5) == y).mean() > 0.96 > (given == y).mean()


def test_language_id(spark):
    rng = random.Random(2)
    made = {"en": ["the", "and", "tion", "wh", "ing"], "de": ["sch", "ung", "der", "und", "ei"], "fr": ["eau", "oi", "les", "ez", "que"], "es": ["cion", "os", "el", "ado", "rr"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(made))
        rows.append((i, " ".join("".join(rng.choice(made[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(20)), lang if rng.random() < 0.9 else None, lang))
    docs = spark.createDataFrame([(i, t, label) for i, t, label, _ in rows] + [(900, None, "en"), (901, "12 !?", "de"), (None, "the thing", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = langid.fit(docs, ~langid.held_out(4, 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i][0] == lang for i, _, _, lang in held) / len(held) > 0.98
    assert got[900] == ("und", 0.0) and got[901][0] == "und" and got[None][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert {p: langid.family(p) for p in ("en", "de", "fr", "xx")} == {"en": "germanic", "de": "germanic", "fr": "romance", "xx": "xx"}
    none = langid.fit(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def check_top_k(rows, found):
    """Against all products in whole numbers; the score of two ids is the greatest of their rows'."""
    clean = [(i, [math.floor(256 * fractions.Fraction(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q in {i for i, _ in clean if i % 50 == 0}:
        scores = {}
        for i, v in clean:
            for j, own in clean:
                if j == q != i and len(v) == len(own):
                    scores[i] = max(scores.get(i, -math.inf), sum(a * b for a, b in zip(own, v)))
        best = sorted((-s, i) for i, s in scores.items())[:5]
        if best:
            want[q] = [(r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(best)]
    got = defaultdict(list)
    for r in found:
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_repeated_ids_and_large_values(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(i % 120, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(0, rows[0][1])] * 4 + [(7, rows[7][1])] * 9
    large = [(200, [1e12, 1.0, 0.0, 0.0]), (201, [1e12, 1.0, 0.5, 0.0]), (202, [-1e12, 3.0, 0.0, 1e-9]), (203, [1e300, 1e308, -1.0, 2.0]), (204, [1e300, 1.1e308, -1.0, 2.0]), (250, [-1e308, 1e308, 0.0, 1.0])]
    for some in (rows, rows + large):
        for block in (4096, 32):
            monkeypatch.setattr(topk, "BLOCK", block)
            monkeypatch.setattr(topk, "QUERIES", block // 4)
            check_top_k(some, topk.top_k(spark.createDataFrame(some, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect())


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).round(2).tolist()) for i in range(700)]
    rows[60] = (60, rows[61][1])  # ties
    rows += [(800, None), (801, [1.0, None] + [0.0] * 14), (802, [float("nan")] * 16), (850, [float("inf")] * 16), (900, [0.5] * 3), (None, rows[0][1]), (100, rows[100][1]), (1000, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    check_top_k(rows, topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect())
    assert topk.top_k(vectors.where("false"), F.lit(True)).count() == 0


def test_no_random_access_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    x = np.floor(rng.pareto(0.7, (2000, 3)) * 50)
    order = np.argsort(-x, axis=0, kind="stable").astype("<u2")
    q = np.abs(rng.normal(size=(20, 3)))
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    qi, vi, s = topk.block_top(x, order, q, none, 5, np.full(20, -np.inf))
    assert len(qi) <= 20 * topk.FEW
    assert not len(topk.block_top(x, order, q, none, 5, np.full(20, 1e12))[0])  # no vector can reach the floor
    for i in range(20):
        assert sorted(s[qi == i])[-5:] == pytest.approx(sorted(q[i] @ x.T)[-5:])


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(file):
    path = queries.tokenizer_path(file)
    want, enc = ids(path), fast_encode.Encoder(path)
    rng = random.Random(4)
    atoms = ["a", "word", "Wörter", " ", "\n", "  ", "\t", "'s", "don't", ",", "12", "½", "€", "\r\n", "\n\n", "...", " 's", "É", "“x”", "日本", "\x85", "ß", "\0", "\1"]
    texts = ODD + ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(4000)]
    whole = enc.whole_tokens()
    assert enc.merger is not None and enc.known
    for some in (texts, texts[:1], ["plain text only", "", "and more"], []):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(some)] == [want(t) for t in some]
        assert enc.count(some, frozenset(whole)) == [len(want(t)) for t in some]
    ended = fast_encode.Encoder(path, 7)
    assert [np.frombuffer(b, "<u4").tolist() for b in ended.ids(ODD)] == [want(t) + [7] for t in ODD]
    assert len(whole) > (30_000 if file.startswith("byte") else 5_000) and all(len(want(t)) == 1 for t in whole[::500])


def test_encoder_takes_unknown_files_to_the_library(tmp_path):
    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    from tokenizers.pre_tokenizers import ByteLevel, Digits, Sequence

    t.pre_tokenizer = Sequence([Digits(individual_digits=True), ByteLevel(add_prefix_space=False)])
    t.save(str(tmp_path / "other.json"))
    enc = fast_encode.Encoder(str(tmp_path / "other.json"))
    assert not enc.known and enc.merger is None
    texts = ["in 2024 there were 12,500", "don't", ""]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert enc.count(texts, frozenset(enc.whole_tokens())) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_counts(spark):
    rows, docs = odd_docs(spark)
    want = ids(queries.tokenizer_path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, queries.tokenizer_path("byte_bpe_50k.json")).collect())
    assert got == Counter((i, len((t or "").encode()), len(want(t)), len(want(t)) > 512) for i, t in rows)


def naive_best_fit(lengths, window):
    """Remaining capacities after piece-by-piece best fit decreasing."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in left if c >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(window - n)
    return sorted(left)


def test_best_fit_by_histogram_equals_piece_by_piece():
    rng = random.Random(6)
    for window in (8, 30, 64):
        for _ in range(60):
            lengths = [rng.randint(1, window) for _ in range(rng.randrange(1, 120))]
            plan, opened = packing.best_fit_decreasing(dict(Counter(lengths)), window)
            used, placed = defaultdict(list), Counter()
            for n, first, last, w, per, at in plan:
                for r in range(first, last):
                    used[w + (r - first) // per].append((at + (r - first) % per * n, n))
                placed[n] += last - first
            assert placed == Counter(lengths) and len(used) == opened
            left = []
            for pieces in used.values():
                end = 0
                for at, n in sorted(pieces):
                    assert at == end
                    end += n
                left.append(window - end)
            assert sorted(left) == naive_best_fit(lengths, window)


def test_packing(spark):
    rows, docs = odd_docs(spark)
    want = ids(queries.tokenizer_path("word_bpe_49k.json"))
    found = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), 1, 256).collect()
    assert len(found) == len(packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), 1, 256, with_ids=False).collect())
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 256
    for i, t in rows:
        if i == 55:
            continue
        own = sorted((r.start, r.ids) for r in found if r.doc_id == i)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == want(t) + [1]
    assert packing.pack(docs.where("false"), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(7)
    for n, high in ((0, 1), (1, 1), (5, 2), (3000, 50257), (1500, 3)):
        a = rng.integers(0, high, n).astype(np.uint32)
        m = wavelet.WaveletMatrix(wavelet.build(a, [4, 9], [n, 0]))
        assert (m.tokens() == a).all() and m.n == n and m.doc_ids.tolist() == [4, 9]
        for i in range(0, n, 97):
            t = int(a[i])
            assert m.access(i) == t and m.rank(t, i) == (a[:i] == t).sum() and m.select(t, m.rank(t, i)) == i
        assert m.count(1 << 20) == 0
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"x" * 100)


def test_token_output_round_trip(spark, tmp_path):
    rows, docs = odd_docs(spark)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    want = ids(path)
    wavelet.write_shards(docs, str(tmp_path / "s"), path, 2, shard_tokens=4000)
    at = 0
    got = sorted(wavelet.read_documents(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]), strict=True):
        own = want(t) + [2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(own), own)
        assert r.ids_crc32 == zlib.crc32(r.ids)
        at += len(own)
    assert wavelet.round_trip(docs.where("false"), path, 2).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    side = 1 << 3
    at = {hilbert.hilbert_index((x, y, z), 3): (x, y, z) for x in range(side) for y in range(side) for z in range(side)}
    assert sorted(at) == list(range(side**3))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(side**3 - 1))


def test_sharding(spark):
    rng = random.Random(8)
    rows = [(i, f"text {rng.randrange(60)}" * rng.randrange(1, 40), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for i in range(400)]
    rows += [(1000 + i, "the same", "en", f"s{i % 5}") for i in range(120)] + [(2000, None, None, None), (2001, "", "en", "s"), (None, "x", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"shard": F.lit("x"), "size": F.lit(1)})
    found = hilbert.layout(docs).collect()
    count = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(count[s]))
    text = {i: t or "" for i, t, _, _ in rows}
    where = defaultdict(set)
    for r in found:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
        where[text[r.doc_id]].add(r.shard)
    # 120 copies fill four or five shards of 32; any other group is whole, unless those shards were its own
    assert len(where["the same"]) <= 6 and sum(len(v) > 1 for v in where.values()) <= 4
    assert hilbert.layout(docs.where("false")).count() == 0
    assert sorted(r.shard for r in hilbert.layout(docs.limit(3)).collect()) == [0, 1, 2]


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, f"text {i % 7}" * (i % 20 + 1), "en", "s") for i in range(60)] + [(5, "another", "de", "s"), (5, "another", "de", "s"), (None, "no id", "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    hilbert.write_shards(docs, str(tmp_path / "s"), 4)
    found = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r) for r in found.select(*docs.columns).collect()) == Counter(rows)
    assert {r.shard: r["count"] for r in found.groupBy("shard").count().collect()} == {0: 16, 1: 16, 2: 16, 3: 16}


def test_shards_prune_files(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(12)
    rows = [(i, f"text number {i} " * rng.randrange(1, 60), rng.choice(["de", "en", "es", "fr"]), f"src{rng.randrange(20):02d}") for i in range(4000)]
    rows += [(9000 + i, "a copy", "en", f"src{i % 20:02d}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"shard": F.lit(3), "moved": F.lit("x"), "slot": F.lit(1)})
    hilbert.write_shards(docs, str(tmp_path / "s"), 16)
    found = spark.read.parquet(str(tmp_path / "s"))
    assert found.select(*docs.columns).exceptAll(docs).count() == 0 and found.count() == len(rows)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "s").rglob("*.parquet")]

    def skipped(**where):
        """The share of rows in files that the predicate's minima and maxima rule out."""
        out = 0
        for f in files:
            names = [f.schema.column(i).path for i in range(f.num_columns)]
            stats = {c: f.row_group(0).column(names.index(c)).statistics for c in where}
            out += f.num_rows * any(not s.min <= where[c] <= s.max for c, s in stats.items())
        return out / len(rows)

    assert min(skipped(lang=x) for x in ("de", "en", "es", "fr")) > 0.4
    assert np.mean([skipped(source=f"src{k:02d}") for k in range(20)]) > 0.4
    assert np.mean([skipped(source=f"src{k:02d}", lang="es") for k in range(20)]) > 0.7


def plain_layout(rows, shards):
    """The documented placement of rows (doc_id, text), in the order of their places, by one list per shard."""
    total = len(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    groups = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        groups[text].append(at)
    out, full = {s: [] for s in range(shards)}, []
    for at, (doc_id, text) in enumerate(rows):
        if len(groups[text]) > 1:
            home = groups[text][0] * shards // total
            (out[home] if len(out[home]) < room[home] else full).append(at)
    left = iter([at for at, (_, text) in enumerate(rows) if len(groups[text]) == 1] + full)
    for s in range(shards):
        while len(out[s]) < room[s]:
            out[s].append(next(left))
    return out


def plain_bins(values):
    """The bin of each value: its share of the smaller values, in sixteenths, numbered anew and spread over the side."""
    known = sorted(v for v in values if v is not None)
    share = {v: known.index(v) * 16 // len(known) for v in set(known)}
    used = sorted(set(share.values()))
    return [(used.index(share[v]) if v is not None else 0) * (16 // max(1, len(used))) for v in values]


def plain_cells(rows):
    """rows: (doc_id, lang, source, text) -> {doc_id: place of its cell on the curve}"""
    dims = [plain_bins([r[1] for r in rows]), plain_bins([r[2] for r in rows]), plain_bins([len((r[3] or "").encode()) for r in rows])]
    return {r[0]: hilbert.hilbert_index(point, 4) for r, point in zip(rows, zip(*dims))}


def plain_hashes(text):
    """The two hashes that order a cell, as signed 64-bit numbers."""
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    data = (text or "").encode()
    return signed(xxhash.xxh64_intdigest(data, 42)), signed(xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest(b"second", 42)))


def test_cells_equal_plain_restatement(spark):
    """Nulls, ties, empty and very long texts, few and many distinct values, repeated rows."""
    rng = random.Random(21)
    rows = [(i, rng.choice(["de", "en", "fr", None]), rng.choice(["hot"] * 9 + [f"s{k:02d}" for k in range(40)]), rng.choice([None, "", "a", "é" * rng.randrange(99), "x" * rng.randrange(3000)])) for i in range(900)]
    rows += [(900, "en", "hot", "long " * 400_000), (901, "en", "hot", "long " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    for some in (docs, docs.repartition(13)):
        cell = F.get(hilbert.curve(), hilbert._cell(some, F.coalesce("text", F.lit(""))))
        assert {r.doc_id: r.c for r in some.select("doc_id", cell.alias("c")).collect()} == plain_cells(rows)


def test_layout_equals_plain_restatement(spark):
    rng = random.Random(13)
    docs = [(i, rng.choice([f"only {i}", f"copied {rng.randrange(30)}", "the hot one"])) for i in range(700)]
    frame = spark.createDataFrame(docs, DOC)  # no language and source, one length bin after the other
    found = hilbert.layout(frame, 8).collect()
    got = defaultdict(set)
    for r in found:
        got[r.shard].add(r.doc_id)
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    cells, hashes = plain_cells([(i, None, None, t) for i, t in docs]), {i: plain_hashes(t) for i, t in docs}
    order = sorted(docs, key=lambda r: (cells[first[r[1]]], *hashes[r[0]], r[0]))
    want = {s: {order[at][0] for at in places} for s, places in plain_layout(order, 8).items()}
    assert {s: len(v) for s, v in got.items()} == {s: len(v) for s, v in want.items()}
    single = {i for i, t in docs if sum(t == u for _, u in docs) == 1}
    assert {s: v & single for s, v in got.items()} == {s: v & single for s, v in want.items()}


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "sha"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(14, 59)).capitalize() + ". " + text(6)) for i in range(40)] + [(90, None), (91, ""), (92, "!!"), (None, text(20))]
    docs, holds = [], {}
    for i in range(300):
        body = text(rng.randrange(30, 400)).split()
        if i % 10 == 0:
            k = rng.randrange(40)
            passage = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: some words replaced
                passage = [word() + "x" if rng.random() < 0.15 else w for w in passage]
            at = rng.randrange(len(body))
            body[at:at] = passage
            holds[i] = k
        elif i % 10 == 1:  # a short quotation is no leak
            body[3:3] = items[i % 40][1].split()[:6]
        docs.append((i, " ".join(body)))
    frame = spark.createDataFrame([*docs, (700, None), (701, ""), (None, items[3][1])], DOC).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    found = {r.doc_id: r.item_ids for r in lsa.contaminated(frame, bench).collect()}
    assert found.pop(None) == [3]
    assert found == {i: [k] for i, k in holds.items()}
    assert lsa.contaminated(frame, bench.where("false")).count() == 0 and lsa.contaminated(frame.where("false"), bench).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lsa.common_subsequence(a, b) == table[-1][-1]
