"""Document index: date range and term search over whole texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.datasets.slices import where

_WORD_CHAR = r"[\p{L}\p{N}]"


def search(documents: DataFrame, text: str, date: str, term: str | None = None, start: str | None = None,
           end: str | None = None) -> DataFrame:
    """Documents of a date range whose text contains every word of the search term.

    Words are runs of letters and digits, compared in lower case; no stemming. The plain
    substring test comes first, so the expression runs only on texts that can match.
    """
    out = where(documents, date, start, end)
    lowered = F.lower(F.col(text))
    for word in re.findall(r"[^\W_]+", (term or "").lower()):
        whole_word = f"(?<!{_WORD_CHAR}){word}(?!{_WORD_CHAR})"
        out = out.filter(lowered.contains(word) & lowered.rlike(whole_word))
    return out
