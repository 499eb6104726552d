"""Text functions: one Column expression each, and the plain-Python model that sequential operators share.

Expressions stay in the JVM. Unicode composition has no built-in, so texts with a character
beyond ASCII pass through an Arrow UDF; for the others it is handed nulls.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import sliced

_BLANK = re.compile("[\t\f\v ]{2,}|[\t\f\v]")
_GAP = re.compile("\n\n\n+")
_BREAK = re.compile(r"\n\s*\n")

#: What Python strips, as a Java character class, and its members of one byte.
_EDGE = "[\\s\\x1c-\\x1f]+"
_EDGES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
#: White space beyond ASCII; a text without it needs no Unicode classes.
_WIDE = "[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def compose(text: Column) -> Column:
    """Canonical composition (NFC)."""
    return F.coalesce(sliced(_composed, "string")(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def stripped(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.when(text.rlike(_WIDE), F.regexp_replace(text, f"(?U)^{_EDGE}|{_EDGE}$", "")).otherwise(F.btrim(text, F.lit(_EDGES)))


def normalize(text: Column, keep_lines: bool = True) -> Column:
    """Composed, without NULs, lines trimmed and their blanks collapsed, no more than one empty line running.

    Only texts with unusual white space take the way over Unicode classes; patterns match where there
    is something to change, not at every word.
    """
    t = F.replace(compose(text), F.lit("\x00"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, " *[\t\f\\x0B][\t\f\\x0B ]*| {2,}", " ")
    lines = (lambda x: x) if keep_lines else (lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    gaps = lambda x: F.regexp_replace(lines(x), "\n{3,}", "\n\n")
    usual = F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    other = F.regexp_replace(t, "(?U)[\\s\\x1c-\\x1f&&[^\n]]+(?=\n|\\z)|(?<=\n|\\A)[\\s\\x1c-\\x1f&&[^\n]]+", "")
    rare = text.rlike(f"{_WIDE}|[\\x1c-\\x1f]")
    return F.when(rare, F.regexp_replace(gaps(other), f"(?U)^{_EDGE}|{_EDGE}$", "")).otherwise(F.btrim(gaps(usual), F.lit(" \n")))


def paragraphs(text: Column) -> Column:
    """The normalized text's parts between empty lines."""
    return F.filter(F.transform(F.split(normalize(text), "(?U)\n\\s*\n"), stripped), lambda p: p != "")


def n_words(text: Column) -> Column:
    """How many runs of anything but white space there are.

    Each becomes one letter, and the letters are counted; only texts with unusual white space are split.
    """
    wide = (F.length(text) < F.octet_length(text)) & text.rlike(_WIDE)
    usual = F.length(F.regexp_replace(F.btrim(text, F.lit(_EDGES)), f"[^{_EDGES}]++[{_EDGES}]*+", "x"))
    return F.when(wide, F.size(F.array_remove(F.split(text, f"(?U){_EDGE}"), ""))).otherwise(usual)


def tokens(n: Column) -> Column:
    """The estimate for so many words."""
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.bround(n * F.lit(1.3)).cast("long")))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded half to even, at least one; none for a blank text. The words are counted once."""
    return F.element_at(F.transform(F.array(n_words(text)), tokens), 1)


def preview(text: Column, start: Column, end: Column, mask: Column, around: int = 24) -> Column:
    """A match with its surroundings; of a masked one longer than 8 only four characters at either end."""
    value = F.substring(text, start + 1, end - start)
    short = F.when(mask & (F.length(value) > 8), F.concat(F.substring(value, F.lit(1), F.lit(4)), F.lit("…"), F.substring(value, F.length(value) - 3, F.lit(4)))).otherwise(value)
    before = F.greatest(F.lit(0), start - around)
    return stripped(F.concat(F.substring(text, before + 1, start - before), short, F.substring(text, end + 1, F.lit(around))))


def yaml_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def normalized(text: str, keep_lines: bool = True) -> str:
    """``normalize`` for one string."""
    text = unicodedata.normalize("NFC", text).replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    if any(x in text for x in ("  ", "\t", "\f", "\v")):
        text = _BLANK.sub(" ", text)
    joined = ("\n" if keep_lines else " ").join(map(str.strip, text.split("\n")))
    return _GAP.sub("\n\n", joined).strip()


def split_paragraphs(text: str) -> list[str]:
    """``paragraphs`` for one string."""
    return [p for p in map(str.strip, _BREAK.split(normalized(text))) if p]
