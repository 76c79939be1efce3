"""Text preparation before encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def composed(*parts: Column | str, sep: str = " ") -> Column:
    """The parts that aren't null or empty, joined and trimmed."""
    kept = [F.when(F.length(p) > 0, F.col(p) if isinstance(p, str) else p) for p in parts]
    return F.trim(F.concat_ws(sep, *kept))


def tokens(text: Column | str) -> Column:
    """Lower-case words without punctuation, between [CLS] and [SEP]; a null or empty text has only the two."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " ")), r"\s+"), lambda w: w != "")
    return F.concat(F.array(F.lit("[CLS]")), F.coalesce(words, F.array().cast("array<string>")), F.array(F.lit("[SEP]")))


def after_last(text: Column | str, mark: str = "/abs/") -> Column:
    """What follows the last ``mark``: the id in an archive's link."""
    return F.substring_index(text, mark, -1)


def hashed_token_vectors(words: Column, dim: int) -> Column:
    """Demonstration encoder: a fixed pseudo-random unit vector for every word."""
    from .vectors import normalized

    return F.transform(words, lambda w: normalized(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda d: (F.xxhash64(w, d) % 2001) / F.lit(1000.0))))
