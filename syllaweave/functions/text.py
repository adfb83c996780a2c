"""Text expressions that stay inside the JVM (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The spellings of "there is none" (reduced form).
NONE_WORDS = ["na", "nil", "none", "notapplicable", "noprerequisite", "noprerequisites", "notrequired", "nothing", "no"]


def let(c: Column, f) -> Column:  # noqa: ANN001
    """``f`` of ``c`` with ``c`` evaluated once, also where ``f`` uses it inside a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def reduced(c: Column) -> Column:
    """Lower-case, ``&`` read as ``and``, only a-z and 0-9 kept; NULL stays NULL."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")


def squeezed(c: Column) -> Column:
    """Whitespace runs to one blank, trimmed; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def words_of(c: Column) -> Column:
    """Maximal runs of a-z and 0-9 of the lower-cased text, in order; NULL gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
