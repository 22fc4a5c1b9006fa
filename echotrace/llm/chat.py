"""Chat formatting in budgeted windows, with a loss mask.

A conversation is written with a template that marks its turns:

    <|im_start|>role
    text<|im_end|>

Texts cannot hold a marker: between `<` and `|` a backslash is put in, before any that
stand there already, which is undone by taking one out. Backslashes and line feeds of
roles are escaped, too.

Prefix sums of the turns' tokens choose the windows: a window takes the next turns as long
as their sum fits the budget beside what it repeats, which is the system turn and the last
few turns before them, as far as those fit a share of the budget. Turns are never cut; one
that exceeds the budget by itself has a window of its own. The loss mask covers the texts
of assistant turns where they are new, so that each is a target once.

Turns are numbered by range partitions, and a conversation is formatted in segments of so
many turns, each with the system turn and the last turns of the segment before it. A
window never crosses a segment. So a conversation of any length is spread over tasks, and
a task holds no more than a window and the history.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.fast_encode import encoder
from echotrace.llm.slices import lean, prepare, record_batch
from echotrace.operators.ranking import place_in_group
from echotrace.session import cut, keep, temporary

# The markers of the template.
START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, SEGMENT = 1024, 4, 256

_GAP, _OWN_GAP = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _GAP.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OWN_GAP.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def turns(window: str) -> list[tuple[str, str]]:
    """The turns `(role, text)` of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


class Packer:
    """Windows of one conversation, turn by turn; it holds the system turn, the history and the window at work."""

    def __init__(self, budget: int, history: int, share: int):
        self.budget, self.history, self.share = budget, history, share
        self.system: tuple[str, str, str, int] | None = None
        self.last: deque = deque(maxlen=max(1, history))
        self.new: list = []
        self.used = 0
        self.repeated: list = []

    def start(self) -> None:
        """Choose what the next window repeats."""
        recent = list(self.last)[-self.history :] if self.history else []
        sums = accumulate(t[3] for t in reversed(recent))
        fit = sum(1 for s in sums if s <= self.share)
        self.repeated = ([self.system] if self.system else []) + recent[len(recent) - fit :]
        self.used = sum(t[3] for t in self.repeated)

    def add(self, item: tuple[str, str, str, int]):
        """A window, if `item (formatted, role, text, tokens)` begins another; then the item is in the new one."""
        done = None
        if self.new and self.used + item[3] > self.budget:
            done = self.close()
        if not self.new:
            self.start()
            if self.used + item[3] > self.budget:  # history gives way to a turn, the system turn does not
                self.repeated = [self.system] if self.system else []
                self.used = sum(t[3] for t in self.repeated)
        self.new.append(item)
        self.used += item[3]
        return done

    def close(self):
        """`(text, repeated turns, new turns, tokens, loss spans)` of the window at work."""
        at, spans, pieces = 0, [], []
        for i, (formatted, role, text, _) in enumerate(self.repeated + self.new):
            if i >= len(self.repeated) and role == "assistant" and len(formatted) > len(END) + 1:
                begin = at + formatted.index("\n") + 1
                spans.append((begin, at + len(formatted) - len(END) - 1))
            pieces.append(formatted)
            at += len(formatted)
        out = "".join(pieces), len(self.repeated), len(self.new), self.used, spans
        self.last.extend(t for t in self.new if t is not self.system)
        self.new = []
        return out


_WINDOW = "conv_id long, segment long, window long, text string, repeated int, new int, tokens long, loss array<struct<start: int, end: int>>"


def windows(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """Formatted windows of `conversations (conv_id, turn, role, text)`, in the order of segment and window.

    `text` is the formatted window, of which the first `repeated` turns are the system turn
    and the history and the next `new` turns are the window's own; `tokens` sums the turns'
    tokens; `loss` are the code point spans of the texts to learn. The system turn is a
    conversation's first turn, if its role is `system`. History is at most `history` turns
    and a quarter of the budget.

    A null text or role is empty. A null conv_id is one conversation like any other, a null
    turn comes first, rows that share a turn come by role and a hash of the text, and repeated rows are
    turns of their own. Texts of any length are kept whole. Other columns are ignored,
    whatever their names. An empty table gives no windows.
    """
    if not 0 <= history < segment:
        raise ValueError("history must be shorter than a segment")
    spark = conversations.sparkSession
    prepare(spark)
    checked = encoder(tokenizer_path).merger is not None  # proven once, on the driver
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    rows = place_in_group(own, "place", ["conv_id"], ["turn", "role", F.xxhash64("text")])
    rows = rows.select("conv_id", (F.col("place") - 1).alias("place"), "role", "text", F.expr(f"(place - 1) div {segment}").alias("segment"))
    rows = keep(rows).withColumn("kind", F.lit(2))  # 0: the system turn of an earlier segment, 1: history from the segment before, 2: own
    # what a later segment begins with: segments beyond the first are those of long conversations only
    tails = rows.where(F.col("place") % segment >= segment - history).withColumns({"segment": F.col("segment") + 1, "kind": F.lit(1)})
    later = rows.where((F.col("place") % segment == 0) & (F.col("segment") > 0)).select(F.col("conv_id").alias("later_id"), F.col("segment").alias("later"))
    first = rows.where("place = 0 and role = 'system'")
    heads = first.drop("segment", "kind").join(later, F.col("conv_id").eqNullSafe(F.col("later_id"))).select("conv_id", "place", "role", "text", F.col("later").alias("segment"), F.lit(0).alias("kind"))
    every = rows.unionByName(tails).unionByName(heads)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = every.repartition(parts, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "place")
    schema = pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()), ("new", pa.int32()), ("tokens", pa.int64()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])

    def run(batches):
        enc = encoder(tokenizer_path, None, checked)
        key, packer, number = None, None, 0

        def row(made):
            nonlocal number
            text, repeated, new, tokens, spans = made
            number += 1
            return key + (number - 1, text, repeated, new, tokens, [{"start": a, "end": b} for a, b in spans])

        for batch in batches:
            out = []
            conv, seg_, kinds, places, roles, texts = (c.to_pylist() for c in batch.columns)
            formatted = [turn(r, t) for r, t in zip(roles, texts)]
            sizes = enc.count(formatted, frozenset())
            for c, s, kind, place, role, text, form, tokens in zip(conv, seg_, kinds, places, roles, texts, formatted, sizes):
                if (c, s) != key:
                    if packer is not None and packer.new:
                        out.append(row(packer.close()))
                    key, packer, number = (c, s), Packer(budget, history, budget // 4), 0
                item = (form, role, text, tokens)
                if kind == 1:
                    packer.last.append(item)
                elif kind == 2 and (made := packer.add(item)):
                    out.append(row(made))
                if place == 0 and role == "system":
                    packer.system = item
            if out:
                yield record_batch(schema, **dict(zip(schema.names, map(list, zip(*out)))))
            lean()
        if packer is not None and packer.new:
            yield record_batch(schema, **dict(zip(schema.names, ([x] for x in row(packer.close())))))

    return sorted_.select("conv_id", "segment", "kind", "place", "role", "text").mapInArrow(run, _WINDOW)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations that `windows` wrote, from the windows alone.

    `turns_sha256` is over role, a line feed, text and a line feed of each new turn,
    `loss_sha256` over the unescaped texts under the mask. A conversation's windows are read
    in order and hashed as they come, so that memory holds one window.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        key, state = (), None

        def digest():
            return key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            out = []
            for conv, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != key:
                    if state:
                        out.append(digest())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{own}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if out:
                yield record_batch(schema, **dict(zip(schema.names, map(list, zip(*out)))))
            lean()
        if state:
            yield record_batch(schema, **dict(zip(schema.names, ([x] for x in digest()))))

    prepare(formatted.sparkSession)
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_conv = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment", "window").select("conv_id", "text", "repeated", "loss")
    return by_conv.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The digests of `read_back` for windows that were written to the shared folder and read again."""
    with temporary(conversations.sparkSession):
        written = keep(windows(conversations, tokenizer_path, budget, history))
        return cut(read_back(written), outside=True)
