"""Language identification by Bayesian fusion of evidence.

The posterior of a language is proportional to
- the likelihood of the text's letter trigrams, tempered to ``EVIDENCE``
  trigrams' worth, as neighbouring trigrams aren't independent;
- the likelihood of the declared markup language and of the address suffix
  given the language, from smoothed counts over all rows;
- the prior of the host: its rows' languages by text alone, shrunk to its
  domain's, and these to those of all rows, the row's own vote left out.

The trigram model is fitted on a sample of labelled rows, bounded for each
language; a label is never evidence for its own row. A language that under
``FEW`` rows are labelled with has no model: its texts are judged by the
languages that have one, so that most of 20 trigrams or more fit none of these
and aren't kept. Counts over hosts, domains, suffixes and declared languages
come from all rows by grouped aggregation.
"""

from __future__ import annotations

import html
import math
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewarden.llm.common import cut, join_counted, map_texts, quoted, small

#: Rows sampled to fit on in all (about; by least hashes), rows that a rarer language has beyond its share of
#: these (about; all if it has fewer), and rows that a language needs.
SAMPLE, EACH, FEW = 12_000, 500, 10
#: Buckets of hashed trigrams, added to counts, and trigrams that a text's evidence is worth at most.
BUCKETS, ADDED, EVIDENCE = 1 << 15, 0.5, 120
#: Fewer trigrams are too few to tell that a text fits no language.
JUDGED = 20
#: Pseudo-counts of host, domain, declared and suffix smoothing; the least posterior of a kept row.
HOST, DOMAIN, MARK, LEAST = 20.0, 50.0, 1.0, 0.5

_OTHER = re.compile(r"[\W\d_]+")
_HIDDEN = re.compile(r"<(script|style)\b", re.IGNORECASE)
_HIDDEN_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"""\slang\s*=\s*["']?([A-Za-z]+)""", re.IGNORECASE)


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the trigrams of the text's lower-case words, single spaces around each; none without letters."""
    clean = _OTHER.sub(" ", text).strip().lower()
    if not clean:
        return np.zeros(0, np.int64)
    x = np.frombuffer(f" {clean} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(49)).astype(np.int64)


def fit(docs: DataFrame, text_col: str, declared_col: str, sample: int = SAMPLE, each: int = EACH, few: int = FEW) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram bucket in each.

    Fitted on about ``sample`` rows that declare a language, and so many more
    of those with under ``each`` rows among them that they have about ``each``, or
    all of their rows. Languages that under ``few`` rows declare are left out.
    """
    labelled = docs.filter(F.col(declared_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(declared_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    sizes = cut(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0]
    if not total:
        return [], np.zeros((0, BUCKETS))
    enough = sizes.filter(F.col("size") >= few)
    rate = F.greatest(F.lit(sample / total), F.lit(each) / F.col("size"))
    labelled = labelled.join(small(cut(enough.select("l", F.ceil(F.least(rate, F.lit(1.0)) * (1 << 20)).alias("most")))), "l")
    labelled = labelled.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.col("most")).select("l", "t")

    def run(frames):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for f in frames:
            for l, t in zip(f.l, f.t):
                if l not in sums:
                    sums[l], rows[l] = np.zeros(BUCKETS, np.int64), 0
                sums[l] += np.bincount(trigrams(t), minlength=BUCKETS)
                rows[l] += 1
        yield pd.DataFrame([(l, n, np.flatnonzero(sums[l]), sums[l][sums[l] > 0]) for l, n in rows.items()], columns=["l", "n", "b", "c"])

    counted = labelled.mapInPandas(run, "l string, n long, b array<long>, c array<long>")
    languages = counted.groupBy("l").agg(F.sum("n").alias("n")).orderBy("l").collect()
    names = [r.l for r in languages]
    model = np.full((len(names), BUCKETS), ADDED)
    cells = counted.filter(F.col("l").isin(names)).select("l", F.explode(F.arrays_zip("b", "c")).alias("x")).groupBy("l", "x.b").agg(F.sum("x.c").alias("c"))
    for l, part in cells.toPandas().groupby("l"):
        model[names.index(l), part.b.to_numpy()] += part.c.to_numpy()
    return names, np.log(model / model.sum(axis=1, keepdims=True))


def visible(markup: str) -> str:
    """Markup with a space for each script, style, comment and tag; what isn't closed is text, or a tag where that is.

    One pass: a mark that has no end isn't looked for again.
    """
    out, at, endless = [], 0, set()
    while (i := markup.find("<", at)) >= 0 and (close := markup.find(">", i)) >= 0:
        out += [markup[at:i], " "]
        at = close + 1
        if (m := _HIDDEN.match(markup, i)) and (name := m[1].lower()) not in endless:
            end = _HIDDEN_END[name].search(markup, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
        elif markup.startswith("<!--", i) and "comment" not in endless:
            end = markup.find("-->", i + 4)
            if end >= 0:
                at = end + 3
            else:
                endless.add("comment")
    return "".join([*out, markup[at:]])


def declared_language(markup: str) -> str | None:
    """The language of the first html tag that has one, in lower case."""
    at = 0
    while m := _HTML.search(markup, at):
        close = markup.find(">", m.end())
        at = len(markup) if close < 0 else close
        if found := _LANG.search(markup, m.end(), at):
            return found[1].lower()
    return None


def from_page(url: str, markup: str) -> tuple[str, str | None, str | None]:
    """A page's visible text, the language that its markup declares and its host; null where there is none."""
    try:
        host = urlsplit(url).hostname
    except ValueError:
        host = None
    return html.unescape(visible(markup)), declared_language(markup), host


def pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, host) of pages; null addresses and markup count as empty."""

    def run(frames):
        for f in frames:
            made = [from_page(u or "", m or "") for u, m in zip(f.u, f.m)]
            yield pd.DataFrame({id_col: f[id_col], **{c: [m[i] for m in made] for i, c in enumerate(("text", "declared", "host"))}})

    name = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"
    return df.select(id_col, F.col(url_col).alias("u"), F.col(html_col).alias("m")).mapInPandas(run, f"{name}, text string, declared string, host string")


def _address(host: Column) -> tuple[Column, Column]:
    """The domain (last two labels) and suffix (last label) of a host with dots; the host itself and null without."""
    labels = F.split(host, r"\.")
    dotted = F.size(labels) > 1
    return F.when(dotted, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host), F.when(dotted, F.lower(F.element_at(labels, -1)))


def evidence(scored: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """(host, declared, rows, of_host, of_domain, given_declared, given_suffix) for every pair of host and declared language, and all rows' votes.

    of_*: rows of each language by text alone; given_*: log P(value | language),
    with ``MARK`` rows added to every value. Null where the value is null.
    """
    add_up = lambda df, by, column: df.groupBy(*by).agg(F.sum("rows").alias("rows"), F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(n))).alias("votes"))
    one = scored.select("host", "declared", F.lit(1).alias("rows"), F.array(*(F.coalesce((F.col("best") == i).cast("double"), F.lit(0.0)) for i in range(n))).alias("v"))
    pairs = cut(add_up(one, ["host", "declared"], "v"))
    whole = pairs.agg(*(F.coalesce(F.sum(F.get("votes", F.lit(i))), F.lit(0.0)) for i in range(n))).first()
    domain, suffix = _address(F.col("host"))
    hosts = cut(add_up(pairs.filter("host is not null").withColumns({"domain": domain, "suffix": suffix}), ["host", "domain", "suffix"], "votes"))

    def given(df: DataFrame, by: str, out: str) -> DataFrame:
        table = cut(add_up(df.filter(F.col(by).isNotNull()), [by], "votes"))
        sums = table.agg(*(F.sum(F.get("votes", F.lit(i))) for i in range(n)), F.count(F.lit(1))).first()
        total = F.array(*(F.lit(float(s or 0.0) + MARK * sums[n]) for s in sums[:n]))
        return table.select(by, F.zip_with("votes", total, lambda x, t: F.log((x + MARK) / t)).alias(out))

    domains = add_up(hosts, ["domain"], "votes").select("domain", F.col("votes").alias("of_domain"))
    of_hosts = hosts.withColumnRenamed("votes", "of_host").drop("rows").join(domains, "domain").join(given(hosts, "suffix", "given_suffix"), "suffix", "left")
    of_hosts = of_hosts.select(F.col("host").alias("h"), "of_host", "of_domain", "given_suffix")
    found = pairs.drop("votes").join(of_hosts, F.col("host") == F.col("h"), "left").drop("h").join(given(pairs, "declared", "given_declared"), "declared", "left")
    return cut(found), list(whole)


def identify(docs: DataFrame, keep: tuple = ("doc_id",), text_col: str = "text", label_col: str = "lang", host_col: str = "source", declared_col: str | None = None, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """``keep``, lang, probability, text_lang, declared and kept for every row.

    kept: the text has letters, its trigrams, unless they are too few to tell, fit a
    language better than chance does, and the posterior is ``least`` or more. A null or empty text, or one
    without letters, is judged by the other evidence and not kept; a null
    declared language, host or suffix is no evidence. Ties go to the language
    first by name. Without any labelled row lang is null and nothing is kept.
    Rows keep their number, repeats included.
    """
    own = lambda c: f"__{c}"
    declared = F.lit(None) if declared_col is None else F.col(declared_col)
    rows = docs.select(*(F.col(c).alias(own(c)) for c in keep), F.col(text_col).alias("text"), declared.cast("string").alias("declared"), F.col(host_col).cast("string").alias("host"))
    kept = [F.col(own(c)).alias(c) for c in keep]
    names, model = fit(docs, text_col, label_col, sample)
    n = len(names)
    if not n:
        return rows.select(*kept, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", F.lit(False).alias("kept"))
    model = model.astype(np.float32).T.copy()

    def run(texts: list[str]) -> dict:
        out: dict = {"logs": [], "best": [], "letters": [], "fits": []}
        for t in texts:
            at = trigrams(t)
            logs = model[at].sum(axis=0, dtype=np.float64)
            out["letters"].append(len(at))
            out["fits"].append(bool(len(at)) and (len(at) < JUDGED or bool(logs.max() / len(at) > -math.log(BUCKETS))))
            out["best"].append(int(logs.argmax()) if len(at) else None)
            out["logs"].append(logs * min(1.0, EVIDENCE / len(at)) if len(at) else logs)
        return out

    scored = cut(map_texts(rows, run, "logs array<double>, best int, letters int, fits boolean", "text", (*map(own, keep), "declared", "host")))
    found, whole = evidence(scored, n)
    everywhere = F.array(*(F.lit((x + 1) / (sum(whole) + n)) for x in whole))
    none = F.array(*[F.lit(0.0)] * n)
    vote = F.array(*(F.when(F.col("best") == i, 1.0).otherwise(0.0) for i in range(n)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def shrunk(counts: str, prior: Column, weight: float) -> Column:
        left = F.when(F.col(counts).isNull(), none).otherwise(F.zip_with(counts, vote, lambda a, b: a - b))
        return F.transform(F.zip_with(left, prior, lambda a, p: a + p * weight), lambda x: x / (total(left) + weight))

    df = join_counted(scored, found, ["host", "declared"], "rows")
    df = df.withColumn("p_domain", shrunk("of_domain", everywhere, DOMAIN))
    df = df.withColumn("p_host", shrunk("of_host", F.col("p_domain"), HOST))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    df = df.withColumn("joint", add(add("logs", F.transform("p_host", lambda x: F.log(x))), add(F.coalesce("given_declared", none), F.coalesce("given_suffix", none))))
    df = df.withColumn("p", F.transform("joint", lambda x: F.exp(x - F.array_max("joint"))))
    df = df.withColumn("probability", 1 / total(F.col("p")))
    name = lambda i: F.get(F.array(*map(F.lit, names)), i)
    lang = name((F.array_position("joint", F.array_max("joint")) - 1).cast("int"))
    return df.select(*kept, lang.alias("lang"), "probability", name(F.col("best")).alias("text_lang"), "declared", (F.col("fits") & (F.col("probability") >= least)).alias("kept"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with their columns as they are.

    Labels only fit the model. Rows that share an id are judged one by one;
    those alike in id, text, label and host together, as they have one answer.
    """
    key = lambda: F.xxhash64(F.col(text_col), F.col(label_col).cast("string"), F.col(host_col).cast("string"))
    named = docs.select(F.col(id_col).alias("__id"), key().alias("__key"), F.col(text_col), F.col(label_col), F.col(host_col))
    found = identify(named, ("__id", "__key"), text_col, label_col, host_col, None, least)
    rejected = small(cut(found.filter(~F.col("kept")).select("__id", "__key").distinct()))
    left = docs.withColumn("__hash", key()).join(rejected, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key")), "left_anti")
    return left.select(*quoted(docs.columns))
