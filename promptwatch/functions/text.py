"""Text primitives: every whitespace, case, digit and base64 rule lives here once.

All helpers take and return ``Column`` so that they stay inside the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike characters and the letters they stand for.
LEET_FROM = "013457@$!+"
LEET_TO = "oieastasit"

# Whitespace as str.split() sees it: the Unicode property plus U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
STRIP_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def text_pattern(pattern: str) -> str:
    """A pattern in the Unicode dialect: ``\\s`` as above, ``.`` stopping at \\n only."""
    return "(?Ud)" + pattern.replace(r"\s", WS)


def fold_case(text: Column) -> Column:
    """Lower case, plus the two letters that only match when case is ignored."""
    return F.translate(F.lower(text), "\u017f\u0131", "si")


def normalize_leet(lower: Column) -> Column:
    """Lower-cased text with look-alikes turned into letters.

    A keyword holds no look-alike itself, so one found in the lower-cased text is
    always found in this form too; keyword searches need no second text.
    """
    return F.translate(lower, LEET_FROM, LEET_TO)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + NOT_WS + "+"))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words joined by one space; reads no further than it must."""
    head = F.regexp_extract(
        text, rf"(?U)^{WS}*+((?:{NOT_WS}++{WS}++){{0,{n - 1}}}+{NOT_WS}*+)", 1
    )
    return F.btrim(F.regexp_replace(head, f"(?U){WS}+", " "), F.lit(" "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


@lru_cache(maxsize=1)
def _digit_tables() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII value, from the Unicode database."""
    src, dst = [], []
    for cp in range(128, sys.maxunicode + 1):
        value = unicodedata.decimal(chr(cp), None)
        if value is not None:
            src.append(chr(cp))
            dst.append(str(value))
    return "".join(src), "".join(dst)


def ascii_digits(text: Column) -> Column:
    src, dst = _digit_tables()
    foreign = text.rlike(r"(?U)[\p{Nd}&&[^0-9]]")
    return F.when(foreign, F.translate(text, src, dst)).otherwise(text)


def max_number(text: Column) -> Column:
    """Largest standalone integer as a double (NULL when there is none)."""
    found = F.regexp_extract_all(ascii_digits(text), F.lit(r"(?U)\b(\d+)\b"), F.lit(1))
    return F.array_max(found.try_cast("array<double>"))


def has_run(text: Column, n: int) -> Column:
    """Is there a run of ``n`` base64 characters? Looks only where a run can begin."""
    return text.rlike(f"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{n}}}")


def decode_base64(match: Column) -> Column:
    """Lower-cased text of one base64 match, NULL when its padding is not valid.

    Invalid UTF-8 sequences are dropped rather than replaced.
    """
    data = F.rtrim(match, F.lit("="))
    n, pads = F.length(data), F.length(match) - F.length(data)
    rest = n % 4
    valid = (rest == 0) | ((rest == 2) & (pads == 2)) | ((rest == 3) & (pads >= 1))
    raw = F.when(valid, F.try_to_binary(data, F.lit("base64")))
    return F.lower(F.translate(F.make_valid_utf8(raw.cast("string")), "\ufffd", ""))


def decoded_runs(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` matches of ``pattern``, decoded; the text is searched once for all of them."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, n), decode_base64)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(column: str, needles: list[str]) -> str:
    """SQL condition: the column holds one of the needles (long chains parse faster as text)."""
    return "(" + " OR ".join(f"contains({column}, {sql_text(n)})" for n in needles) + ")"
