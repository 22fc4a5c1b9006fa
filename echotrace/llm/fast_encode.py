"""Token ids of whole texts, each distinct unit of a batch encoded once.

Both tokenizer files split a text into pre-tokens that are encoded independently, so the
ids of a text are the ids of its pre-tokens in order. Here a text is cut before single
spaces and line feeds into units of one or a few pre-tokens, such that no pre-token
crosses a unit. A batch of texts is split, its distinct units are found, encoded as one
text, and their ids gathered, all by array operations; nothing is kept from batch to
batch. Texts in which a run of blanks could be cut wrongly are split by the file's own
pattern instead. Texts outside the alphabet for which that pattern and the library's are
known to agree, and texts that hold an added token's string, go to the library whole, and
so does everything if the file's normaliser and pre-tokenizer are not of the two known kinds.

Units are merged by a second library where the vocabulary is in merge order, so that
taking the lowest rank first takes the same merges; this is checked on every vocabulary
string of the alphabet, once on the driver, and any difference sends units to the first library.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from echotrace.llm.slices import lean

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLICE = 1_000_000  # bytes of texts encoded at once

# The split patterns of the two tokenizer families, as their files state them.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What the files say of their text handling, beside the pattern.
BYTE_STEP = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_STEPS = [{"type": "Split", "pattern": {"Regex": WORD_LEVEL}, "behavior": "Removed", "invert": True}, BYTE_STEP | {"use_regex": False}]
WORD_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

# Precomposed Latin text and common punctuation: here letter, digit and blank classes,
# lower-casing and normal form C are the same in every Unicode version. Left out are
# U+0130, whose lower case has two characters, and U+0149, which is deprecated.
ALPHABET = [
    c
    for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x17F), 0x2013, 0x2014, *range(0x2018, 0x201F), 0x2022, 0x2026, 0x20AC])
    if c not in "İŉ"
]
# Marks outside the alphabet: between units, at the end of a word, and before a cut.
GAP, CLOSE, CUT = "\0", "\1", "\2"


def _of(*kinds: str) -> str:
    return "".join(re.escape(c) for c in ALPHABET if unicodedata.category(c)[0] in kinds)


def narrowed(pattern: str) -> re.Pattern:
    """A split pattern over the alphabet, its Unicode classes spelled out."""
    outside = "[^" + _of("L", "N") + re.escape("\t\n\r ") + "]"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", outside).replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    pattern = pattern.replace(r"\p{L}", f"[{_of('L')}]").replace(r"\p{N}", f"[{_of('N')}]")
    return re.compile(pattern.replace(r"\s", r"[\t\n\r ]").replace(r"\S", r"[^\t\n\r ]"))


PLAIN = re.compile("[" + "".join(map(re.escape, ALPHABET)) + "]*+")
# Two blanks in a row are two pre-tokens wherever they stand, but for the end of a text; of more the first ones are one.
BLANK_RUN = re.compile(r"[\t\n\r ]{3}|[\t\n\r ]{2}\Z")
BLANK_PAIRS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")  # without these there is no such run


class Encoder:
    """Ids of texts by one tokenizer file, each text ended by `end_id` if that is given.

    `checked` says whether the second library has been found equal; if it isn't given, it is checked.
    """

    def __init__(self, path: str, end_id: int | None = None, checked: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = [] if end_id is None else [end_id]
        spec = json.loads(self.tokenizer.to_str())
        form, step = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        self.word_level = (form or {}).get("normalizers") == WORD_FORM and step.get("pretokenizers") == WORD_STEPS
        self.known = self.word_level or (form is None and step == BYTE_STEP)
        pattern = WORD_LEVEL if self.word_level else BYTE_LEVEL
        self.pattern = narrowed(pattern)
        self.gapped = re.compile(f"{GAP}|" + self.pattern.pattern.replace("[^", f"[^{GAP}"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.merger = None
        if self.known and checked is not False and self._merges(spec["model"]) and checked is None:
            strings = sorted({p for t in self.strings() for p in self.pieces(t) if not self._odd(p)})
            found = self._merged(strings)
            same = found is not None and all(np.array_equal(e.ids, own) for e, own in zip(self._library(strings), np.split(found[0], np.cumsum(found[1])[:-1])))
            self.merger = self.merger if same else None
        del spec
        lean()  # what the check took

    def strings(self) -> list[str]:
        """The vocabulary entries that are whole texts of the alphabet."""
        decoded = {self.tokenizer.decode([i], skip_special_tokens=False) for i in range(self.tokenizer.get_vocab_size())}
        return sorted(s for s in decoded if s and "�" not in s and self.plain(s))

    def plain(self, text: str) -> bool:
        return self.known and PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if self.word_level else text)

    def _library(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _merges(self, model: dict) -> bool:
        """Sets up the second library with the same vocabulary, the end of a word being a byte of its own."""
        try:
            import tiktoken
        except ImportError:
            return False
        suffix = model.get("end_of_word_suffix") or ""
        if sys.byteorder != "little" or suffix not in ("", "</w>"):
            return False
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        code = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        ranks: dict[bytes, int] = {}
        for t, i in vocab.items():
            ends = bool(suffix) and t.endswith(suffix) and t != suffix
            body = t.removesuffix(suffix) if ends else t
            if not all(c in code for c in body):
                return False
            ranks[bytes(code[c] for c in body) + (CLOSE.encode() if ends else b"")] = i
        if order != sorted(order) or len(ranks) != len(vocab) or any(ranks.get(bytes([b]), len(vocab)) >= order[0] for b in range(256)):
            return False
        if self.word_level:
            pattern = f"[^{CLOSE}]+{CLOSE}"
        else:
            # blanks within a unit are pre-tokens of their own, so nothing needs to look ahead
            pattern = f"{GAP}|" + BYTE_LEVEL.replace(r"\s+(?!\S)|\s+", r"\s").replace(r"[^\s", f"[^{GAP}\\s")
        self.merger = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[(GAP + CLOSE if self.word_level else GAP).encode()]
        return True

    def _merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all units, one after the other, and how many each has; None if it can't be done at once."""
        if self.merger is None:
            return None
        joined = GAP.join(units) + GAP
        if self.word_level:
            joined = CLOSE.join(self.gapped.findall(joined)) + CLOSE
        ids = self.merger.encode_to_numpy(joined).astype(np.uint32)
        marks = ids == self.mark
        ends = np.flatnonzero(marks)
        if len(ends) != len(units):
            return None
        return ids[~marks], np.diff(ends, prepend=-1) - 1

    def _odd(self, unit: str) -> bool:
        """A run of blanks that is one pre-token."""
        return len(unit) > 1 and unit.isspace()

    def _encoded(self, units: list[str], runs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Like `_merged`, by the first library where need be; with `runs`, units may be runs of blanks."""
        odd = {u for u in units if self._odd(u)} if runs else set()
        found = self._merged([u for u in units if u not in odd])
        if found is not None and not odd:
            return found
        own = iter(np.split(found[0], np.cumsum(found[1])[:-1])) if found is not None else None
        rest = [u for u in units if found is None or u in odd]
        told = iter(np.array(e.ids, np.uint32) for e in self._library(rest))
        parts = [next(told) if found is None or u in odd else next(own) for u in units]
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def _units(self, texts: list[str]) -> tuple[pa.Array, bool]:
        """The units of plain texts, a list for each, and whether runs of blanks may be among them."""
        if self.word_level:
            return pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string())), False
        runs = [any(b in t for b in BLANK_PAIRS) and BLANK_RUN.search(t) is not None for t in texts]
        cut = pa.array([t.replace(" ", CUT + " ").replace("\n", CUT + "\n") for t, run in zip(texts, runs) if not run], pa.large_string())
        units = pc.split_pattern(cut, CUT)
        if not any(runs):
            return units, False
        units = pa.concat_arrays([units, pa.array([self.pattern.findall(t) for t, run in zip(texts, runs) if run], units.type)])
        return units.take(pa.array(np.argsort(np.argsort(runs, kind="stable")))), True

    def _coded(self, texts: list[str]) -> tuple[list[str], bool, np.ndarray, np.ndarray]:
        """The distinct units of plain texts, whether there may be runs, the number of each unit, and where each text's units end."""
        units, runs = self._units(texts)
        coded = units.flatten().dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), runs, coded.indices.to_numpy(), np.cumsum(pc.list_value_length(units).to_numpy())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        plain = [self.plain(t) for t in texts]
        chosen = [t for t, ok in zip(texts, plain) if ok]
        ids, ends = np.empty(0, np.uint32), np.empty(0, np.int64)
        if chosen:
            units, runs, at, last = self._coded(chosen)
            store, sizes = self._encoded(units, runs)
            n = sizes[at]
            after = np.append(0, np.cumsum(n))
            ends = after[last]
            ids = store[np.repeat((np.cumsum(sizes) - sizes)[at] - after[:-1], n) + np.arange(after[-1])]
        if len(chosen) < len(texts):
            own = iter(np.split(ids, ends[:-1]))
            parts = [next(own) if ok else np.array(self._library([t])[0].ids, np.uint32) for t, ok in zip(texts, plain)]
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts], dtype=np.int64)
        sizes = np.diff(ends, prepend=0)
        return (np.insert(ids, ends, self.end[0]), sizes + 1) if self.end else (ids, sizes)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode(texts)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def whole_tokens(self) -> list[str]:
        """The vocabulary strings that, as texts of their own, are one pre-token and one token.

        This is the offline proof of the shortcut: each vocabulary entry is turned back into
        its string, split by the pattern and encoded, and kept only if both give one.
        """
        strings = [s for s in self.strings() if self.pieces(s) == [s]]
        return [s for s, e in zip(strings, self._library(strings)) if len(e.ids) == 1]

    def count(self, texts: list[str], whole: frozenset[str]) -> list[int]:
        """The number of tokens of each text; pre-tokens in `whole` count one, the rest is merged."""
        plain = [self.plain(t) for t in texts]
        chosen = [t for t, ok in zip(texts, plain) if ok]
        found = iter(())
        if chosen:
            units, runs, at, last = self._coded(chosen)
            split = [p for u in units for p in ([u] if self._odd(u) else self.pattern.findall(u), GAP) for p in p] if runs else self.gapped.findall(GAP.join(units) + GAP)
            rest = list(set(split).difference(whole, [GAP]))
            counts = dict(zip(rest, self._encoded(rest, runs)[1].tolist())) if rest else {}
            counts[GAP] = 1 << 40
            each = np.fromiter(map(counts.get, split, repeat(1)), np.int64, len(split))
            gaps = each == 1 << 40
            each[gaps] = 0
            sizes = np.diff(np.cumsum(each)[gaps], prepend=0)
            found = iter(np.diff(np.append(0, np.cumsum(sizes[at]))[last], prepend=0).tolist())
        return [next(found) if ok else len(self._library([t])[0].ids) for t, ok in zip(texts, plain)]


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int | None = None, checked: bool | None = None) -> Encoder:
    """One encoder for each Python worker, file and end id."""
    return Encoder(path, end_id, checked)
