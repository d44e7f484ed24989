"""Tokens as the full-text index sees them: lower case, without diacritics, runs of letters and digits."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with diacritics and their bases, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if a != b and b in string.ascii_letters]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_ACCENTED, _PLAIN = _folds()
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold_string(text: str) -> str:
    return text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
