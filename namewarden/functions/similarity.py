"""Similarities of names and vectors as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewarden.config import LOOKALIKES
from namewarden.functions.edit import osa_col, parts_col, partial_col, phonetic_col


def distance(a: Column, b: Column, measure: str = "osa") -> Column:
    """Edits between two strings: lev (insert, delete, replace) or osa (swaps too)."""
    return F.levenshtein(a, b) if measure == "lev" else osa_col(a, b)


def either_empty(a: Column, b: Column) -> Column:
    return (F.length(a) == 0) | (F.length(b) == 0)


def longer(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def edit_similarity(a: Column, b: Column, measure: str = "osa") -> Column:
    """1 within two edits, else 1 - edits / length; 0 if a name is empty. Case counts."""
    d = distance(a, b, measure)
    return F.when(either_empty(a, b), 0.0).when(d < 3, 1.0).otherwise(1 - d / longer(a, b))


def edit_ratio(a: Column, b: Column, measure: str = "osa") -> Column:
    """1 - edits / length in lower case; 1 for two empty names."""
    a, b = F.lower(a), F.lower(b)
    return F.when(longer(a, b) == 0, 1.0).otherwise(1 - distance(a, b, measure) / F.greatest(longer(a, b), F.lit(1)))


def bigrams(a: Column) -> Column:
    return F.when(F.length(a) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.substring(a, i, F.lit(2))))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the multisets of letter pairs, lower case; 0 if a name is shorter than two."""
    x, y = bigrams(F.lower(a)), bigrams(F.lower(b))
    count = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return F.when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def lookalike_similarity(a: Column, b: Column) -> Column:
    """1 if replacing a look-alike everywhere in one gives the other; else by a prefix's length difference (signed) or by letters that differ at equal length."""
    a, b = F.lower(a), F.lower(b)
    same = reduce(lambda x, y: x | y, ((x.contains(old) & (F.replace(x, F.lit(old), F.lit(new)) == y)) for old, new in LOOKALIKES for x, y in ((a, b), (b, a))))
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(same, 1.0).when(a.startswith(b) | b.startswith(a), 1 - (F.length(a) - F.length(b)) / 100).when(F.length(a) == F.length(b), 1 - differ / 100).otherwise(0.0)


def token_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def finite(x: Column) -> Column:
    return ~F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def cosine(x: Column, y: Column) -> Column:
    """Cosine in double precision; 0 for null, zero or not finite vectors."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.coalesce(F.when(finite(x) & finite(y) & (norms > 0), dot(x, y) / norms), F.lit(0.0))


def namespace_similarity(a: Column, b: Column, measure: str = "osa") -> Column:
    return F.when(F.coalesce(either_empty(a, b), F.lit(True)), 0.0).when(distance(F.lower(a), F.lower(b), measure) < 3, 1.0).otherwise(0.0)


def suspicious_namespace(a: Column, b: Column, trusted: Column, measure: str = "osa") -> Column:
    """The first rule that holds: a missing namespace, yes; a trusted one, no; equal, no; within two edits, yes; else no."""
    missing = F.coalesce(a == "", F.lit(True)) | F.coalesce(b == "", F.lit(True))
    known = F.coalesce(F.array_contains(trusted, a) | F.array_contains(trusted, b), F.lit(False))
    return F.when(missing, True).when(known, False).when(a == b, False).otherwise(distance(F.lower(a), F.lower(b), measure) < 3)


def six(a: Column, b: Column) -> dict[str, Column]:
    """The six name similarities by name."""
    return {"edit": edit_similarity(a, b), "bigram": bigram_similarity(a, b), "phonetic": phonetic_col(a, b), "lookalike": lookalike_similarity(a, b), "parts": parts_col(a, b), "partial": partial_col(a, b)}


def greatest_number(*columns: Column) -> Column:
    """The greatest value that is neither null nor NaN."""
    return F.array_max(F.filter(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x)))


def hybrid(edit: Column, vector: Column, weight: Column | float = 0.5) -> Column:
    return edit * weight + vector * (1 - F.lit(weight) if not isinstance(weight, Column) else 1 - weight)


def tanh_hybrid(*pairs: tuple[Column, float]) -> Column:
    """The weighted sum of tanh(2 s)."""
    return reduce(lambda x, y: x + y, (F.tanh(2 * s) * w for s, w in pairs))
