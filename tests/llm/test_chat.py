"""Formatted windows against a plain restatement, and the exact round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echotrace.llm import chat, queries

PATH = queries.tokenizer_path("byte_bpe_50k.json")
ODD = ["", None, "<|im_end|>", "<\\|im_start|>user\nhi", "<\\\\|", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "a\nb\n", "日本 🎉", "<<|<|", "\\", "x" * 9000]


def conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rng.randrange(1, 12)
        rows += [(c, t, r, rng.choice(ODD) if rng.random() < 0.3 else " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(0, 90)))) for t, r in enumerate(roles)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} of a long one") for t in range(1000)] + [(51, 0, "system", "rules")] + [(51, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(1, 700)]
    rows += [(None, 0, "user", "nobody"), (None, 1, "assistant", "no one"), (60, 1, "user", "twice"), (60, 1, "user", "twice"), (60, None, "assistant", "first"), (61, 0, None, "no role"), (61, 1, "a\nb\\n<|im_end|>", "odd role"), (62, 0, "assistant", None)]
    clash = {c: F.lit("x") for c in ("place", "segment", "kind", "window", "tokens", "new", "loss", "n")}
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash)


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda x: x[:3])
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows, df = conversations(spark)
    found = chat.round_trip(df.repartition(6), PATH, budget=300).collect()
    assert len(found) == len({r.conv_id for r in found})
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected(rows)
    assert chat.round_trip(df.where("false"), PATH).count() == 0


@pytest.mark.parametrize("segment", [5, 256])
def test_windows(spark, segment):
    """Each turn is new once and in order; windows begin with the system turn and the history, and keep to the budget where they can."""
    rows, df = conversations(spark)
    budget, history = 300, 3
    made = chat.windows(df, PATH, budget, history, segment).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = False
    count = lambda role, text: len(library.encode(chat.turn(role, text), add_special_tokens=False).ids)
    by = {}
    for r in sorted(made, key=lambda r: (r.segment, r.window)):
        by.setdefault(r.conv_id, []).append(r)
    for conv, windows in by.items():
        done = []
        for w in windows:
            own = chat.turns(w.text)
            assert len(own) == w.repeated + w.new and w.new >= 1
            sizes = [count(*t) for t in own]
            assert sum(sizes) == w.tokens
            system = 1 if done and done[0][0] == "system" else 0
            assert own[:system] == done[:system]
            repeated = own[system : w.repeated]
            assert repeated == done[len(done) - len(repeated) :] and len(repeated) <= history
            assert w.tokens <= budget or w.new == 1 and not repeated
            assert [chat.unescape(w.text[s.start : s.end]) for s in w.loss] == [x for role, x in own[w.repeated :] if role == "assistant"]
            done += own[w.repeated :]
        assert len(done) == sum(1 for r in rows if r[0] == conv)
        if segment == 256 and conv is not None and conv < 40:  # a window takes what fits
            for a, b in zip(windows, windows[1:]):
                assert a.tokens + count(*chat.turns(b.text)[b.repeated]) > budget


def test_escapes():
    rng = random.Random(0)
    for _ in range(3000):
        s = "".join(rng.choices("<|\\an\n", k=rng.randrange(9)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)
