"""Byte-oriented text helpers.

Texts are UTF-8 strings; lengths and offsets are counted in bytes and case
folding touches ASCII letters only (a per-byte upper-casing table), so Unicode
``upper``/``lower``/``ilike`` must not be used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only letters the matcher folds (ASCII a-z to A-Z).
LOWER_ASCII = string.ascii_lowercase
UPPER_ASCII = string.ascii_uppercase


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_fold(c) -> Column:
    """Upper-case ASCII letters only; every other byte is left as is.

    ``upper`` does just that for pure ASCII and is much faster there."""
    c = _col(c)
    return (F.when(F.octet_length(c) == F.char_length(c), F.upper(c))
            .otherwise(F.translate(c, LOWER_ASCII, UPPER_ASCII)))


def atoi(c) -> Column:
    """C ``atoi``: optional leading whitespace, sign and digits, else 0."""
    lead = F.regexp_extract(_col(c).cast("string"),
                            r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    return F.coalesce(F.nullif(lead, F.lit("")).try_cast("int"), F.lit(0))


def split_tokens(c, sep: str = ",") -> Column:
    """``strtok`` on one separator: split, drop empty tokens, keep order, no trim."""
    return F.filter(F.split(_col(c), _regex_literal(sep)), lambda x: x != F.lit(""))


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def regex_quote(word: str) -> str:
    """Quote a word for a Java regex: escape every ASCII non-alphanumeric.

    (``\\Q..\\E`` would break on a word containing ``\\E``.)
    """
    return "".join("\\" + ch if ord(ch) < 128 and not ch.isalnum() else ch
                   for ch in word)
