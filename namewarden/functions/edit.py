"""String measures that have no built-in expression, as plain functions of two strings and as Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from namewarden.config import DELIMITERS, PART_END, PART_INSIDE, PART_LIKE, PART_MORE, PART_ORDER


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no substring edited twice.

    A column of the table of distances is two numbers, whose bits tell where it
    rises and falls down the letters of ``a``.
    """
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, same, before, distance = every, 0, 0, 0, len(a)
    for y in b:
        here = at.get(y, 0)
        swapped = ((~same & here) << 1) & before
        same = ((((here & up) + up) ^ up) | here | down | swapped) & every
        right, left = (down | ~(same | up)) & every, same & up
        distance += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & every, (left << 1) & every
        up, down, before = (left | ~(same | right)) & every, right & same, here
    return distance


#: Letters of the shorter string that a batch holds in one number, and letters of the longer one that are worth a batch's steps.
BATCHED, STEPS = 64, 256


def osa_batch(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``osa`` of many pairs, a letter of all longer strings at a time; pairs of long strings one by one."""
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b))) if len(a) else ((), ())
    m, n = np.array([*map(len, short)], np.int64), np.array([*map(len, long)], np.int64)
    out = np.where(m == 0, n, 0)
    alone = (m > BATCHED) | (n > STEPS)
    for i in np.flatnonzero(alone):
        out[i] = osa(short[i], long[i])
    rows = np.flatnonzero(~alone & (m > 0))
    if not len(rows):
        return out
    m, n = m[rows], n[rows]

    def letters(strings: Sequence[str], sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
        """Code points, a row for each string, ``fill`` behind its end."""
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
        table = np.full((len(sizes), width), fill, np.int32)
        table[np.arange(width) < sizes[:, None]] = flat
        return table

    x, y = letters([short[i] for i in rows], m, BATCHED, -1), letters([long[i] for i in rows], n, int(n.max()), -2)
    one = np.uint64(1)
    up, down, same, before = (np.full(len(rows), v, np.uint64) for v in (np.iinfo(np.uint64).max, 0, 0, 0))
    last, distance = (m - 1).astype(np.uint64), m.copy()
    for j in range(y.shape[1]):
        here = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view("<u8").ravel()
        swapped = ((~same & here) << one) & before
        same = (((here & up) + up) ^ up) | here | down | swapped
        right, left = down | ~(same | up), same & up
        step = ((right >> last) & one).astype(np.int64) - ((left >> last) & one).astype(np.int64)
        distance += np.where(j < n, step, 0)
        right, left = right << one | one, left << one
        up, down, before = left | ~(same | right), right & same, here
    out[rows] = distance
    return out


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring; where there is one of a length there are shorter ones."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        n = (low + high + 1) // 2
        parts = {a[i : i + n] for i in range(len(a) - n + 1)}
        if any(b[j : j + n] in parts for j in range(len(b) - n + 1)):
            low = n
        else:
            high = n - 1
    return low


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; the bits of a number tell how far a's letters have been matched."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    left = every
    for y in b:
        here = left & at.get(y, 0)
        left = ((left + here) | (left - here)) & every
    return len(a) - left.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """The best indel similarity, 0 to 1, of the shorter string and a stretch of the longer one of at most its length."""
    if not a or not b:
        return 0.0

    def best(s: str, t: str) -> float:
        m = len(s)
        stretches = {t[max(0, i) : i + m] for i in range(1 - m, len(t))}
        return max(2 * _subsequence(s, w) / (m + len(w)) for w in stretches)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def soundex(word: str) -> str:
    """American Soundex of the letters of a word."""
    letters = re.sub("[^A-Z]", "", word.upper())
    if not letters:
        return ""
    group = {c: str(d) for d, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
    out, last = letters[0], group.get(letters[0])
    for c in letters[1:]:
        code = group.get(c)
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def metaphone(word: str) -> str:
    """The original Metaphone key: consonant sounds, vowels only in front."""
    w = re.sub("[^A-Z]", "", word.upper())
    w = re.sub(r"([^C])\1+", r"\1", w)
    w = re.sub("^(KN|GN|PN|AE|WR)", lambda m: m[0][1], w)
    w = re.sub("^X", "S", re.sub("^WH", "W", re.sub("MB$", "M", w)))
    rules = (
        ("SCH", "SK"), ("CIA|TIA|TIO", "X"), ("CH|SH", "X"), ("SC(?=[IEY])", "S"), ("C(?=[IEY])", "S"), ("CK", "K"), ("C", "K"),
        ("DG(?=[EIY])", "J"), ("D", "T"), ("GH(?![AEIOU]|$)", ""), ("GN(ED)?$", "N"), ("(?<!G)G(?=[IEY])", "J"), ("GH", "F"), ("G", "K"),
        ("PH", "F"), ("Q", "K"), ("SIO|SIA", "X"), ("TH", "0"), ("TCH", "X"), ("V", "F"), ("W(?![AEIOU])", ""), ("X", "X"), ("Y(?![AEIOU])", ""), ("Z", "S"),
        ("(?<=[AEIOU])H(?![AEIOU])", ""),
    )
    w = w.replace("X", "KS") if "X" in w[1:] else w
    for pattern, sound in rules:
        w = re.sub(pattern, sound, w)
    return w[:1] + re.sub("[AEIOU]", "", w[1:])


def phonetic(a: str, b: str) -> float:
    """Half for equal Soundex, half for equal Metaphone keys."""
    return ((soundex(a) == soundex(b)) + (metaphone(a) == metaphone(b))) / 2


def _overlap(a: str, b: str) -> float:
    return common_substring(a, b) / max(len(a), len(b))


def parts_similarity(a: str, b: str) -> float:
    """Likeness of the words of two names, by longest common substrings.

    Pairs of words that share over half count with their length, a little more
    the more pairs there are, in the same order on both sides, and where the
    first or the last words contain one another. Without such a pair a name in
    the other counts from 0.7 by its share.
    """
    a, b = a.lower(), b.lower()
    left, right = ([p for p in re.split(DELIMITERS, s) if p] for s in (a, b))
    if not left or not right:
        return 0.0
    pairs = [(x, y, s) for x in left for y in right if (s := _overlap(x, y)) > PART_LIKE]
    if not pairs:
        return PART_INSIDE + (1 - PART_INSIDE) * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    score = sum(max(len(x), len(y)) * s for x, y, s in pairs) / sum(map(len, left + right))
    score *= 1 + PART_MORE * len(pairs) / min(len(left), len(right))
    places = [[side.index(p[k]) for p in pairs] for k, side in enumerate((left, right))]
    if len(pairs) > 1 and all(p == sorted(p) for p in places):
        score += PART_ORDER
    for end in (0, -1):
        if left[end] in right[end] or right[end] in left[end]:
            score += PART_END
    return min(1.0, score)


def pair_udf(function: Callable[[str, str], float], kind: str) -> Callable[..., Column]:
    """A function of two strings as an Arrow UDF, made when it is first used; null if either is null."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], index=a.index, dtype=object)

    return lambda *columns: F.pandas_udf(over, kind)(*columns)


def osa_col(a: Column, b: Column) -> Column:
    """``osa`` as an Arrow UDF; null if either is null."""

    def over(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = pd.Series([None] * len(x), index=x.index, dtype="Int32")
        out[known] = osa_batch(x[known].to_list(), y[known].to_list())
        return out

    return F.pandas_udf(over, "int")(a, b)


parts_col = pair_udf(parts_similarity, "double")
partial_col = pair_udf(partial_ratio, "double")
phonetic_col = pair_udf(phonetic, "double")
