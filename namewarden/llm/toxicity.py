"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a word and of a word-stem lexicon, how near
their hits are to a second person, capitals, punctuation, obfuscation and
length. All is learned from a bounded sample of labelled training rows in
``PARTS`` parts: a part's features come from the lexicon of the other parts,
the trees from all parts but the last, the calibration from the last, so none
sees the rows that it is fitted on through another. Texts are then scored with
the lexicon of all parts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.llm.common import cut, map_texts, process_cache

#: Labelled rows that are fitted on at most; the rest of the labels is not read into the model.
SAMPLE = 20_000
#: Rows whose crc32(id as text) mod FOLDS is 0 are held out. Parts of the sample.
FOLDS, PARTS = 5, 5
#: Lexicon: toxic documents that a unit must be in, least z score of its log odds, units at most, stem lengths.
SEEN, LEAST_Z, UNITS, STEMS = 4, 3.0, 4000, (4, 5, 6)
#: Boosting: trees, depth, step, rows in a leaf, bins of a feature, ridge.
TREES, DEPTH, STEP, LEAF, BINS, RIDGE = 60, 3, 0.2, 10, 32, 1.0
#: Second-person pronouns by language, as fixed values: English, German, French, Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Digits and signs that stand for letters in obfuscated words, as fixed values.
LEET = str.maketrans("013457@$!", "oieastasi")

_TOKEN = re.compile(r"[\w@$!*]+")
_MIXED = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_]){3,}[^\W\d_]\b")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")

FEATURES = ("words", "stems", "word_hits", "stem_hits", "word_weight", "stem_weight", "word_most", "stem_most", "second", "near", "near_hits", "capitals", "shouted", "exclaimed", "punctuation", "mixed", "spaced", "stretched", "digits", "length")


def kinds() -> np.ndarray:
    """For each code point whether it is a letter (1), upper case (2), a digit (4); made once in a worker."""
    known = process_cache()
    if "kinds" not in known:
        every = list(map(chr, range(0x110000)))
        known["kinds"] = sum(np.fromiter(map(is_one, every), np.uint8, len(every)) << k for k, is_one in enumerate((str.isalpha, str.isupper, str.isdigit))).astype(np.uint8)
    return known["kinds"]


def tokens(text: str) -> list[str]:
    """Lower-case words; those that mix letters with digits or signs are read as letters, final signs left off."""
    found = _TOKEN.findall(text.lower())
    odd = [i for i, t in enumerate(found) if not t.isalpha()]
    for i in odd:
        t = found[i].rstrip("!*@$_")
        found[i] = t.translate(LEET).replace("*", "").replace("_", "") if any(map(str.isalpha, t)) else None
    return [t for t in found if t is not None] if odd else found


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The numbers named in ``FEATURES``."""
    found = tokens(text)
    n = max(1, len(found))
    hits = [(i, words[w]) for i, w in enumerate(found) if w in words]
    # a word's longest stem in the lexicon counts
    stem_hits = []
    for i, w in enumerate(found):
        if len(w) > STEMS[0]:
            for k in reversed(STEMS):
                if len(w) > k and w[:k] in stems:
                    stem_hits.append((i, stems[w[:k]]))
                    break
    you = np.array([i for i, w in enumerate(found) if w in SECOND])
    at = np.array(sorted({i for i, _ in hits} | {i for i, _ in stem_hits}))
    near = np.full(len(at), 50.0)
    if len(you) and len(at):
        p = np.searchsorted(you, at)
        near = np.minimum(np.abs(at - you[np.clip(p, 0, len(you) - 1)]), np.abs(at - you[np.clip(p - 1, 0, len(you) - 1)])).clip(0, 50).astype(float)
    kind = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    count = lambda bit: int(np.count_nonzero(kind & bit))
    letters = max(1, count(1))
    chars = max(1, len(text))
    raw = text.split()
    many = max(1, len(raw))
    return [
        math.log1p(len(found)), sum(map(STEMS[0].__lt__, map(len, found))) / n, len(hits) / n, len(stem_hits) / n,
        sum(x for _, x in hits) / n, sum(x for _, x in stem_hits) / n, float(len(hits)), float(len(stem_hits)),
        len(you) / n, float(near.min()) if len(near) else 50.0, float((near <= 5).sum()) / n,
        count(2) / letters, sum(len(w) > 1 for w in filter(str.isupper, raw)) / many,
        (text.count("!") + text.count("?")) / chars, sum(text.count(c) for c in ".,;:#%&*$") / chars,
        len(_MIXED.findall(text)) / many, len(_SPACED.findall(text)) / many, len(_STRETCHED.findall(text)) / many,
        count(4) / chars, math.log1p(len(text)),
    ]


def units(text: str) -> set[str]:
    """A document's words, and its stems with a mark behind."""
    found = set(tokens(text))
    return {w for w in found if len(w) > 1} | {f"{w[:k]}\x00" for w in found for k in STEMS if len(w) > k}


class Trees:
    """Boosted regression trees for the logistic loss, with second-order gains over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = self.bins(x)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.start = math.log(rate / (1 - rate))
        self.trees: list[list[tuple]] = []
        f = np.full(len(y), self.start)
        for _ in range(TREES if len(y) >= 2 * LEAF else 0):
            p = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            self._grow(tree, binned, p - y, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            f += self._one(tree, binned)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, tree: list, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        """Appends the node for ``rows`` and those below it; the node's number."""
        me, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        tree.append((-1, 0, 0, 0, -STEP * total_g / (total_h + RIDGE)))
        best = (1e-6, -1, 0)
        for c in range(x.shape[1] if depth < DEPTH and len(rows) >= 2 * LEAF else 0):
            b = x[rows, c]
            size = len(self.edges[c]) + 1
            n, gs, hs = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (None, g[rows], h[rows]))
            gain = gs**2 / (hs + RIDGE) + (total_g - gs) ** 2 / (total_h - hs + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain = np.where((n >= LEAF) & (len(rows) - n >= LEAF), gain, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), c, int(gain.argmax()))
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            a = self._grow(tree, x, g, h, rows[left], depth + 1)
            b = self._grow(tree, x, g, h, rows[~left], depth + 1)
            tree[me] = (best[1], best[2], a, b, 0.0)
        return me

    @staticmethod
    def _one(tree: list, x: np.ndarray) -> np.ndarray:
        t = np.array(tree)
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            feature = t[at, 0].astype(int)
            inner = feature >= 0
            go = np.where(x[np.arange(len(x)), np.maximum(feature, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(int)
            at = np.where(inner, go, at)
        return t[at, 4]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.start + sum((self._one(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: scores and non-decreasing rates, to be interpolated; rates stay inside (0, 1). Equal scores are one from the start."""
    at, which = np.unique(score, return_inverse=True)
    sums, sizes = np.bincount(which, y, len(at)), np.bincount(which, minlength=len(at))
    pools: list[list[float]] = []  # sum of labels, rows, least and greatest score
    for s, v, n in zip(at.tolist(), sums.tolist(), sizes.tolist()):
        pools.append([v, n, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    x = [e for p in pools for e in (p[2], p[3])]
    r = [(p[0] + 0.5) / (p[1] + 1) for p in pools for _ in (0, 1)]
    return np.array(x), np.maximum.accumulate(np.array(r))


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], trees: Trees, curve: tuple[np.ndarray, np.ndarray]) -> None:
        self.words, self.stems, self.trees, self.curve = words, stems, trees, curve

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.words, self.stems) for t in texts]).reshape(len(texts), len(FEATURES))
        margin = self.trees.margin(x)
        if not len(self.curve[0]):
            return 1 / (1 + np.exp(-margin))
        # within a pool the margin still orders, by a hair
        return np.clip(np.interp(margin, *self.curve) + 1e-6 * np.tanh(margin / 10), 0.0, 1.0)


def lexicon(counted: DataFrame, without: int | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems, with the log odds of being in a toxic document, from rows (unit, toxic, clean), arrays by part, without one."""

    def total(column: str) -> Column:
        return sum((F.get(column, F.lit(k)) for k in range(PARTS) if k != without), F.lit(0))

    counted = counted.select("unit", total("toxic").alias("t"), total("clean").alias("c"))
    sizes = counted.filter("unit = ''").first()
    if sizes is None:
        return {}, {}
    odds = F.log((F.col("t") + 0.5) / (sizes.t + 1)) - F.log((F.col("c") + 0.5) / (sizes.c + 1))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counted.filter((F.col("unit") != "") & (F.col("t") >= SEEN)).withColumn("odds", odds).filter(z >= LEAST_Z).orderBy(z.desc(), "unit").limit(UNITS).collect()
    words = {r.unit: r.odds for r in best if not r.unit.endswith("\x00")}
    return words, {r.unit[:-1]: r.odds for r in best if r.unit.endswith("\x00")}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled rows that aren't held out, by least hashes of their ids.

    An id that is labelled more than once is toxic if any label is; labels
    other than 0 and 1 and null ids aren't used.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y")).withColumn("h", F.xxhash64("__id", F.lit(3)))
    chosen = known.orderBy("h", "__id").limit(sample)
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("__id", F.lit(4)), F.lit(PARTS)).cast("int"))
    # at most ``sample`` rows of an id, a label and a part; their texts are written once and read twice
    rows = cut(docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("t", "y", "part"))

    def count(frames):
        seen: Counter = Counter()
        for f in frames:
            for t, y, k in zip(f.t, f.y, f.part):
                seen.update((u, y, k) for u in units(t))
                seen["", y, k] += 1
        yield pd.DataFrame([(u, y, k, n) for (u, y, k), n in seen.items()], columns=["unit", "y", "part", "n"])

    def by_part(y: int) -> Column:
        return F.array(*(F.sum(F.when((F.col("y") == y) & (F.col("part") == k), F.col("n")).otherwise(0)) for k in range(PARTS)))

    counted = cut(rows.mapInPandas(count, "unit string, y int, part int, n long").groupBy("unit").agg(by_part(1).alias("toxic"), by_part(0).alias("clean")).filter("unit = '' or aggregate(toxic, 0L, (s, x) -> s + x) >= 2"))
    lexicons = [lexicon(counted, k) for k in range(PARTS)]

    def measure(frames):
        for f in frames:
            yield pd.DataFrame({"x": [features(t, *lexicons[k]) for t, k in zip(f.t, f.part)], "y": f.y, "part": f.part})

    got = rows.mapInPandas(measure, "x array<double>, y int, part int").toPandas()
    got = got.assign(key=[tuple(v) for v in got.x]).sort_values(["part", "y", "key"], kind="stable")
    x, y = np.array(got.x.to_list()).reshape(len(got), len(FEATURES)), got.y.to_numpy(float)
    last = got.part.to_numpy() == PARTS - 1
    trees = Trees(x[~last], y[~last])
    both = last.any() and 0 < y[last].sum() < last.sum()
    return Model(*lexicon(counted), trees, isotonic(trees.margin(x[last]), y[last]) if both else (np.zeros(0), np.zeros(0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row's whole text; nothing but the text goes into a score.

    Null and empty texts are scored as texts without words. A null id isn't
    held out. Rows keep their number; other columns are left out.
    """

    def run(texts: list[str]) -> dict:
        s = model(texts)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    scored = map_texts(docs, run, "score double, predicted int", text_col, (id_col,))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", "predicted")
