"""Text expressions: trimming, normal form, tokens, similarity, rounding, escaping."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from echotrace.session import ship

# The white space of ECMAScript regular expressions and String.trim.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

#: Texts of these characters only are in normal form KC: ASCII, precomposed Latin letters,
#: kana without voicing marks of their own, and unified ideographs.
KC_STABLE = "^[\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u3001-\\u3035\\u3041-\\u3096\\u30A1-\\u30FE\\u4E00-\\u9FFF]*$"

JAPANESE = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
TOKEN = f"([{JAPANESE}ー]+|[\\p{{L}}\\p{{N}}_]+)"
#: The same in texts of Latin-1, which have no kanji or kana; single characters are looked up in one table.
LATIN_TOKEN = "[" + "".join(c for c in map(chr, range(256)) if c == "_" or unicodedata.category(c)[0] in "LN") + "]+"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def required_text(c: Column) -> Column:
    """True where the string has a character that is no white space."""
    return F.coalesce(c.rlike(f"[^{JS_SPACE}]"), F.lit(False))


def _normal_form(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def nfkc(c: Column) -> Column:
    """Normal form KC. Only texts that may change are sent to Python; the others stay in the JVM."""
    ship(SparkSession.active())
    stable = _ascii(c) | ~c.rlike("[^\\x00-\\x7F\\u00C0-\\u00FF]") | c.rlike(KC_STABLE)  # cheap tests first
    return F.coalesce(F.pandas_udf(_normal_form, "string")(F.when(~stable, c)), c)


def normalize_text(c: Column, ignore_urls: bool = True, ignore_mentions: bool = True) -> Column:
    """Normal form KC, lower case, URLs and mentions out, white space collapsed and trimmed, in this order."""
    out = F.lower(nfkc(c))
    if ignore_urls:
        out = F.regexp_replace(out, f"https?://[^{JS_SPACE}]+", " ")
    if ignore_mentions:
        out = F.regexp_replace(out, "@[a-z0-9_]+", " ")
    # single spaces stay as they are, and after this no other white space is left to trim
    return F.trim(F.regexp_replace(out, f" [{JS_SPACE}]+|[{JS_SPACE}&&[^ ]][{JS_SPACE}]*", " "))


def tokens(norm: Column) -> Column:
    """The token set of a normalised text.

    A run that holds kanji or kana gives its two-character pieces, or itself if it is one
    character; any other run of letters, digits and underscores is a token.
    """
    runs = F.regexp_extract_all(norm, F.lit(TOKEN), 1)
    pieces = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    split = F.transform(runs, lambda t: F.when(t.rlike(f"[{JAPANESE}]") & (F.length(t) > 1), pieces(t)).otherwise(F.array(t)))
    latin = _ascii(norm) | ~norm.rlike("[^\\x00-\\xFF]")
    return F.array_distinct(F.when(latin, F.regexp_extract_all(norm, F.lit(LATIN_TOKEN), F.lit(0))).otherwise(F.flatten(split)))


def utf16_tokens(norm: Column) -> Column:
    """Like `tokens`, with pieces of two UTF-16 units, as binary: characters beyond the basic plane split."""
    runs = F.regexp_extract_all(norm, F.lit(TOKEN), 1)
    units = lambda t: F.encode(t, "UTF-16BE")
    pieces = lambda t: F.transform(
        F.sequence(F.lit(0), (F.octet_length(units(t)) / 2 - 2).cast("int")), lambda i: F.substr(units(t), (2 * i + 1).cast("int"), F.lit(4))
    )
    split = F.transform(runs, lambda t: F.when(t.rlike(f"[{JAPANESE}]") & (F.octet_length(units(t)) > 2), pieces(t)).otherwise(F.array(units(t))))
    return F.array_distinct(F.flatten(split))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two token sets; 0 if one is empty."""
    inter = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(inter / (F.size(left) + F.size(right) - inter))


#: Odd multiples of 1/200 whose double lies below the decimal tie.
LOW_TIES = [k / 200 for k in range(1, 200, 2) if Decimal(k / 200) < Decimal(k) / 200]


def to_fixed2(x: Column) -> Column:
    """Rounding to two places by the double's exact value, halves away from zero, for x in 0..1."""
    return F.when(x.isin(LOW_TIES), F.floor(x * 100) / 100).otherwise(F.round(x, 2))


def ordinal_id(prefix: str, n: Column) -> Column:
    """`C-001`: at least three digits, never cut."""
    return F.format_string(prefix + "%03d", n)


def csv_safe(c: Column) -> Column:
    """A quoted CSV cell that a spreadsheet takes for text."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.when(text.rlike("^[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def encode_uri_component(c: Column) -> Column:
    """Percent-encoding that keeps `A-Za-z0-9-_.!~*'()`."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves toward positive infinity."""
    return F.floor(x + 0.5).cast("long")


def duration_label(ms: Column) -> Column:
    """Days, hours, minutes and seconds with their Japanese units; leading zero units are left out."""
    total = round_half_up(ms / 1000)
    day, hour, minute = F.floor(total / 86400), F.floor(total % 86400 / 3600), F.floor(total % 3600 / 60)
    part = lambda n, unit, shown: F.when(shown, F.concat(n.cast("string"), F.lit(unit)))
    return F.concat_ws(
        "",
        part(day, "日", day > 0),
        part(hour, "時間", (hour > 0) | (day > 0)),
        part(minute, "分", (minute > 0) | (hour > 0) | (day > 0)),
        F.concat((total % 60).cast("string"), F.lit("秒")),
    )


def date_label(ms: Column) -> Column:
    """Date and time in UTC, as Japanese medium format has them."""
    return F.date_format(F.timestamp_millis(ms), "yyyy/MM/dd H:mm:ss")


def ja(c: Column) -> Column:
    """The string under Japanese collation, for sorting and comparing."""
    return F.collate(c.cast("string"), "ja")


def is_https(c: Column) -> Column:
    """True for a URL of scheme https with a host."""
    url = js_trim(c)
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def iso_ms(c: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 time with a zone, else null."""
    zoned = js_trim(c).rlike("(?i)(Z|[+-]\\d{2}:?\\d{2})$")
    return F.when(zoned, F.unix_millis(F.try_to_timestamp(js_trim(c))))


def clean_account(c: Column) -> Column:
    return F.regexp_replace(js_trim(c), "^@+", "")
