"""What was done to a name to make another, by rules of our own; a classifier of meaning isn't part of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewarden.config import DELIMITERS, LOOKALIKES
from namewarden.functions.edit import osa_col, phonetic_col
from namewarden.functions.names import tokens_trained


def _bare(name: Column) -> Column:
    """Without its delimiters, in lower case."""
    return F.regexp_replace(F.lower(name), DELIMITERS, "")


def _unscoped(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "^@[^/]*/", "")


def attack_class(name: Column, target: Column, sounds: bool = True) -> Column:
    """The first class that fits a name and the one it imitates; null if none does, the names are equal or one is null.

    delimiters: alike but for these; scope: alike but for an npm scope; order:
    the same words in another order; lookalike: one sign written for another
    throughout; typo: one edit or swap of neighbours; addition: the target and
    more before or behind it; omission: words of the target left out; sound:
    equal phonetic keys (only with ``sounds``, an Arrow function).
    """
    a, b = F.lower(name), F.lower(target)
    x, y = tokens_trained(name), tokens_trained(target)
    looks = F.lit(False)
    for old, new in LOOKALIKES:
        looks = looks | (a.contains(old) & (F.replace(a, F.lit(old), F.lit(new)) == b)) | (b.contains(old) & (F.replace(b, F.lit(old), F.lit(new)) == a))
    filled = (F.length(a) > 0) & (F.length(b) > 0)
    # one edit is within two by the built-in measure, which spares the other pairs the alignment
    typo = F.when(F.levenshtein(a, b, 2) >= 0, osa_col(a, b) == 1).otherwise(False)
    out = (
        F.when(~filled | (a == b), None)
        .when((_bare(name) == _bare(target)) & (F.length(_bare(name)) > 0), "delimiters")
        .when(_unscoped(name) == _unscoped(target), "scope")
        .when((F.size(x) > 1) & (F.sort_array(x) == F.sort_array(y)), "order")
        .when(looks, "lookalike")
        .when(typo, "typo")
        .when(a.startswith(b) | a.endswith(b), "addition")
        .when((F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0) & (F.size(x) < F.size(y)), "omission")
    )
    return out.when(phonetic_col(a, b) == 1.0, "sound") if sounds else out
