"""The learned operators' parts against plain versions, and near-dedup's recall on the tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewarden.llm import language, secrets, simhash, toxicity
from namewarden.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# toxicity


def plain_tokens(text):
    out = []
    for t in re.findall(r"[\w@$!*]+", text.lower()):
        if not t.isalpha():
            while t and t[-1] in "!*@$_":
                t = t[:-1]
            if not any(c.isalpha() for c in t):
                continue
            t = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in t if c not in "*_")
        out.append(t)
    return out


def plain_features(text, words, stems):
    """One number after another, each by its own pass."""
    w = plain_tokens(text)
    n, raw = max(1, len(w)), text.split()
    letters, chars, many = max(1, sum(c.isalpha() for c in text)), max(1, len(text)), max(1, len(raw))
    stem = lambda x: next((x[:k] for k in (6, 5, 4) if len(x) > k and x[:k] in stems), None)
    hits, stem_hits = [i for i, x in enumerate(w) if x in words], [i for i, x in enumerate(w) if stem(x)]
    you = [i for i, x in enumerate(w) if x in toxicity.SECOND]
    near = [min([50, *(abs(i - j) for j in you)]) for i in sorted({*hits, *stem_hits})]
    spaced = re.findall(r"\b(?:[^\W\d_][ .\-_]){3,}[^\W\d_]\b", text)
    return {
        "words": math.log1p(len(w)), "stems": sum(len(x) > 4 for x in w) / n, "word_hits": len(hits) / n, "stem_hits": len(stem_hits) / n,
        "word_weight": sum(words[w[i]] for i in hits) / n, "stem_weight": sum(stems[stem(w[i])] for i in stem_hits) / n, "word_most": len(hits), "stem_most": len(stem_hits),
        "second": len(you) / n, "near": min(near, default=50), "near_hits": sum(d <= 5 for d in near) / n,
        "capitals": sum(c.isupper() for c in text) / letters, "shouted": sum(x.isupper() and len(x) > 1 for x in raw) / many,
        "exclaimed": sum(c in "!?" for c in text) / chars, "punctuation": sum(c in ".,;:#%&*$" for c in text) / chars,
        "mixed": len(re.findall(r"[^\W\d_][\d@$!*]+[^\W\d_]", text)) / many, "spaced": len(spaced) / many,
        "stretched": len(re.findall(r"([^\W\d_])\1\1", text)) / many, "digits": sum(c.isdigit() for c in text) / chars, "length": math.log1p(len(text)),
    }


def odd_texts(seed, n):
    rng = random.Random(seed)
    pieces = ["you", "Idiot", "1d10t", "st*pid", "GO", "away!!", "i d i o t", "sooo", "naïve", "du", "bist", "...", "№5", "word", "wording", "a@b", "$$$", "!", "ÜBER", "x" * 30, "\n", "?", "tu", "vous", "7"]
    return ["", " ", "!!!", "you", *(" ".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(n))]


def test_features_equal_the_plain_ones():
    words, stems = {"idiot": 2.5, "stpid": 1.5, "word": 0.5}, {"idio": 1.0, "wordi": 0.75, "xxxxxx": 2.0, "über": 0.1}
    for t in odd_texts(1, 300):
        assert dict(zip(toxicity.FEATURES, toxicity.features(t, words, stems))) == pytest.approx(plain_features(t, words, stems)), t


def plain_trees(x, y, trees, depth):
    """Margins of boosted trees, by trying every cut of every feature."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, toxicity.BINS + 1)[1:-1]).tolist())) for c in x.T]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    f = np.full(len(y), math.log(rate / (1 - rate)))
    ridge, leaf = toxicity.RIDGE, toxicity.LEAF

    def grow(rows, g, h, left_depth, out):
        a, b = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for c in range(x.shape[1] if left_depth and len(rows) >= 2 * leaf else 0):
            for cut in cuts[c]:
                inside = rows[x[rows, c] <= cut]
                if leaf <= len(inside) <= len(rows) - leaf:
                    p, q = g[inside].sum(), h[inside].sum()
                    gain = p * p / (q + ridge) + (a - p) ** 2 / (b - q + ridge) - a * a / (b + ridge)
                    if gain > best[0] + 1e-12:
                        best = (gain, (c, cut))
        if best[1] is None:
            out[rows] = -toxicity.STEP * a / (b + ridge)
            return
        inside = x[rows, best[1][0]] <= best[1][1]
        grow(rows[inside], g, h, left_depth - 1, out)
        grow(rows[~inside], g, h, left_depth - 1, out)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), p - y, p * (1 - p), depth, step)
        f = f + step
    return f


def test_trees_equal_the_plain_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 12)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=160), rng.integers(0, 4, 160), np.zeros(160), rng.normal(size=160).round(1)])
    y = (x[:, 0] + x[:, 1] > 1.5 + rng.normal(size=160)).astype(float)
    made = toxicity.Trees(x, y)
    assert made.margin(x) == pytest.approx(plain_trees(x, y, 12, toxicity.DEPTH), abs=1e-9)
    assert toxicity.Trees(x[:5], y[:5]).trees == [] and len(toxicity.Trees(x[:0], y[:0]).margin(x)) == 160


def test_calibration_is_the_plain_monotone_fit():
    rng = np.random.default_rng(5)
    s = rng.integers(-20, 20, 300) / 10
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s))).astype(float)
    at = sorted(set(s.tolist()))
    total, n = [y[s == v].sum() for v in at], [(s == v).sum() for v in at]
    # the monotone fit at i: the greatest over starts up to i of the least over ends from i of the mean between
    mean = lambda a, b: sum(total[a : b + 1]) / sum(n[a : b + 1])
    fit = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    pools = defaultdict(list)
    for i, v in enumerate(fit):
        pools[round(v, 12)].append(i)
    want = {}
    for p in pools.values():
        rate = (sum(total[i] for i in p) + 0.5) / (sum(n[i] for i in p) + 1)
        want |= {at[i]: rate for i in p}
    x, r = toxicity.isotonic(s, y)
    raised = np.maximum.accumulate([want[v] for v in at])
    assert [float(np.interp(v, x, r)) for v in at] == pytest.approx(raised.tolist())


def test_the_lexicon_equals_plain_counts(spark):
    texts = odd_texts(6, 200)
    rows = [(i, t) for i, t in enumerate(texts)]
    toxic = {i: int("idiot" in plain_tokens(t)) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, y in toxic.items()], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    import zlib

    known = [i for i in toxic if zlib.crc32(str(i).encode()) % 5]
    units = lambda t: {("word", w) for w in plain_tokens(t) if len(w) > 1} | {("stem", w[:k]) for w in plain_tokens(t) for k in (4, 5, 6) if len(w) > k}
    inside, outside = Counter(), Counter()
    for i in known:
        (inside if toxic[i] else outside).update(units(texts[i]))
    n, m = sum(toxic[i] for i in known), sum(not toxic[i] for i in known)
    want = {}
    for u in set(inside) | set(outside):
        t, c = inside[u], outside[u]
        odds = math.log((t + 0.5) / (n + 1)) - math.log((c + 0.5) / (m + 1))
        if t >= toxicity.SEEN and odds / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= toxicity.LEAST_Z:
            want[u] = odds
    assert {**{("word", w): x for w, x in model.words.items()}, **{("stem", s): x for s, x in model.stems.items()}} == pytest.approx(want)
    got = toxicity.score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == toxic[r.doc_id] for r in got if r.held_out]) > 0.9


def test_scores_over_the_edge_table(spark, edge_dir, edge_rows):
    """Equal texts have equal scores, null ones those of empty ones, and each is what the model says of the text alone."""
    import zlib

    docs, labels = spark.read.parquet(f"{edge_dir}/documents.parquet"), spark.read.parquet(f"{edge_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = sorted({t or "" for _, t, *_ in edge_rows})
    said = dict(zip(texts, model(texts).tolist()))
    assert model.trees.margin(np.array([list(plain_features(t, model.words, model.stems).values()) for t in texts])) == pytest.approx(model.trees.margin(np.array([toxicity.features(t, model.words, model.stems) for t in texts])))
    got = Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in QUERIES["op10_toxicity"](spark, edge_dir).collect())
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert got == Counter((i, out(i), round(said[t or ""], 9), int(said[t or ""] >= 0.5)) for i, t, *_ in edge_rows)


# language


def plain_bucket(a, b, c):
    mask = (1 << 64) - 1
    x = (ord(a) * 0x9E3779B97F4A7C15 & mask) ^ (ord(b) * 0xC2B2AE3D27D4EB4F & mask) ^ (ord(c) * 0x165667B19E3779F9 & mask)
    return (x * 0xFF51AFD7ED558CCD & mask) >> 49


def test_the_trigram_model_equals_plain_counts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for alphabet in ("abcde  1.", "xyzé  -", "αβγ  ") for _ in range(15)] + ["", None, "12 34"]
    rows = [(t, ("aa", "bb", "cc")[i // 15] if i < 45 else "aa") for i, t in enumerate(texts)] + [("abc", "rare"), ("abc", None)]
    names, model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(2), "text", "lang")
    assert names == ["aa", "bb", "cc"]
    for k, l in enumerate(names):
        n = Counter()
        for t, of in rows:
            words = re.sub(r"[\W\d_]+", " ", t or "").strip().lower()
            if of == l and words:
                s = f" {words} "
                n.update(plain_bucket(*s[i : i + 3]) for i in range(len(s) - 2))
        total = sum(n.values()) + language.ADDED * language.BUCKETS
        assert {b: model[k][b] for b in n} == pytest.approx({b: math.log((x + language.ADDED) / total) for b, x in n.items()})
        assert model[k].sum() == pytest.approx(sum(math.log((n[b] + language.ADDED) / total) for b in range(language.BUCKETS)))


def test_a_language_under_the_least_rows_has_no_model_in_any_table(spark):
    df = spark.createDataFrame([("der Hund schläft", "de")] * 3, "text string, lang string")
    assert language.fit(df, "text", "lang")[0] == [] and language.fit(df, "text", "lang", few=3)[0] == ["de"]


# secrets


def plain_base(text):
    kinds = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least, found = {"access": 18, "hex": 16}, []
    for k, (kind, pattern) in enumerate(kinds.items()):
        pattern = re.sub(r"\(password[^)]*\)", lambda m: f"(?i:{m[0]})", pattern)
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= least[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def test_base_spans_are_those_of_their_patterns(spark, edge_dir, edge_rows):
    tables = [(edge_dir, [(i, t) for i, t, *_ in edge_rows]), (SF, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])]
    for folder, rows in tables:
        got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op3_secret_scan"](spark, folder).collect())
        want = Counter()
        for i, t in rows:
            spans = plain_base(t or "")
            count = Counter(s.split(":")[0] for s in spans)
            want[i, count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
        assert got == want
    texts = dict(tables[1][1])
    for r in QUERIES["op3_secret_scan"](spark, SF).filter("n_confirmed > 0").collect():
        for kind, a, b in (s.split(":") for s in r.spans.split(",")):
            part = texts[r.doc_id][int(a) : int(b)]
            assert {"jwt": part.count(".") == 2, "pem": part.startswith("-----BEGIN") and part.endswith("-----"), "ssh": part.startswith("b3BlbnNzaC")}.get(kind, True)
            if kind == "jwt":
                assert secrets._header(secrets.unbase64(part.split(".")[0]).decode("latin-1"), 0)


# near-dedup


def test_recall_of_near_dedup_on_a_table(spark):
    """All pairs of the table by SimHash or by the Jaccard similarity of five words: classes by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets, prints, holders = {}, {}, defaultdict(list)
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        prints[i] = simhash.fingerprint(t)
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = 0
    for i, _ in rows:
        shared = Counter(j for s in sets[i] for j in holders[s] if j > i)
        alike = [j for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
        alike += [j for j, _ in rows if j > i and (prints[i] ^ prints[j]).bit_count() <= 4]
        links += len(alike)
        for j in alike:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    want = {i for i, _ in rows if top(i) == i}
    got = {r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()}
    gone = set(sets) - want
    assert links > 100 and len(gone) > 40
    assert len(gone - got) >= 0.999 * len(gone) and got >= want
