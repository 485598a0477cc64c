"""The queries of the name-confusion operators over the test tables, and their DuckDB SQL.

Part names stand for package names, summed quantities for downloads, brands for
groups, page addresses for paths, embeddings' ids for names with vectors.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewarden.config import TRUSTED_NAMESPACES
from namewarden.functions import names as N
from namewarden.functions import similarity as S
from namewarden.functions.attacks import attack_class
from namewarden.operators import benignity as B
from namewarden.operators import catalog as K
from namewarden.operators import evaluate as E
from namewarden.operators import learned, pairwise, releases, subwords, vector_index, vectors
from namewarden.operators import neighbors as J
from namewarden.operators import popular as P
from namewarden.operators.durable import cut, ensure_checkpoints
from namewarden.plans import detect as D
from namewarden.plans import api, documents
from namewarden.sources import readers, sinks
from namewarden.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LEAST_POPULAR = 800.0
COMMANDS = ("install", "test", "run", "small ring", "red bolt", "red belt", "hot gear", "old golt")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_name, popularity): quantities sold of each part name."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "part").join(sold, "p_partkey").groupBy(F.col("p_name").alias("package_name")).agg(F.sum("q").alias("popularity"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).filter(F.col("popularity") >= LEAST_POPULAR)


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of distinct part names, a few dozen names; Spark broadcasts one side if its size allows."""
    one = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return one.join(one.withColumnRenamed("a", "b"), F.col("a") != F.col("b"))


def six_digits(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


PARTS = "parts AS (SELECT p_name AS package_name, sum(q) AS popularity FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1), listed AS (SELECT * FROM parts WHERE popularity >= 800)"
PAIRS = "n AS (SELECT DISTINCT p_name AS a FROM part), pairs AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a <> y.a)"


# popular lists


@query("SELECT p_name || '#' || p_partkey AS package_name, q AS popularity FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE q >= 800")
def popular_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("popularity"))
    rows = table(spark, sf_dir, "part").join(sold, F.col("l_partkey") == F.col("p_partkey")).withColumn("package_name", F.concat_ws("#", "p_name", "p_partkey"))
    return P.popular(rows, "npm", threshold=LEAST_POPULAR)


@query("SELECT p_name || '#' || p_partkey AS package_name, q AS popularity FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey ORDER BY 2 DESC, 1 LIMIT 100")
def popular_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("popularity"))
    rows = table(spark, sf_dir, "part").join(sold, F.col("l_partkey") == F.col("p_partkey")).withColumn("package_name", F.concat_ws("#", "p_name", "p_partkey"))
    return P.popular(rows, "npm", top=100)


@query("SELECT s_name AS package_name, s_acctbal AS popularity FROM supplier WHERE s_acctbal <= 5000 ORDER BY 2, 1")
def popular_rank_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("package_name"), F.col("s_acctbal").alias("popularity"))
    return P.popular(rows, "maven", threshold=5000)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE s_acctbal <= 5000) AS n_popular FROM supplier")
def popular_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s_acctbal") <= 5000).alias("n_popular"))


@query(f"WITH {PARTS} SELECT DISTINCT p_type AS package_name, 9999999.0::DOUBLE AS popularity FROM part WHERE p_type NOT IN (SELECT package_name FROM listed) UNION ALL SELECT * FROM listed")
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_targets(listed(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_type").alias("package_name")), "npm")


@query(f"WITH {PARTS} SELECT * FROM listed WHERE package_name NOT IN (SELECT p_name FROM part WHERE p_size = 1)")
def remove_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.without(listed(spark, sf_dir), table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_name").alias("package_name")))


@query("WITH s AS (SELECT s_name AS package_name, s_acctbal AS popularity FROM supplier) SELECT q.package_name AS query, p.package_name, p.popularity FROM s q JOIN s p ON q.popularity < 10000 AND p.popularity >= 10 * q.popularity")
def popular_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("package_name"), F.col("s_acctbal").alias("popularity"))
    return P.narrowed(rows.select("package_name"), rows, "npm")


# neighbours


FLAT = """SELECT query, package_name, edits, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY edits, package_name) AS place FROM (
    SELECT q.package_name AS query, p.package_name, levenshtein(lower(q.package_name), lower(p.package_name)) AS edits FROM parts q JOIN {popular} p ON lower(q.package_name) <> lower(p.package_name))
  WHERE edits < 3 AND edits < 2 * length(query) // 3) WHERE place <= 10"""


@query(f"WITH {PARTS} {FLAT.format(popular='listed')}")
def neighbors_flat_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.flat(parts(spark, sf_dir), listed(spark, sf_dir), vector_over=None)
    return found.select("query", "package_name", F.col("edits").cast("long").alias("edits"), F.col("place").cast("long").alias("place"))


@query(f"WITH {PARTS} {FLAT.format(popular='(SELECT * FROM listed ORDER BY popularity DESC, package_name LIMIT 20)')}")
def neighbors_flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.flat(parts(spark, sf_dir), P.popular(listed(spark, sf_dir), "npm", top=20), vector_over=None)
    return found.select("query", "package_name", F.col("edits").cast("long").alias("edits"), F.col("place").cast("long").alias("place"))


@query("""WITH v AS (SELECT 'vector-' || vec_id AS package_name, embedding::DOUBLE[] AS e, label FROM embeddings),
x AS (SELECT q.package_name AS query, p.package_name, levenshtein(q.package_name, p.package_name) AS edits, list_cosine_similarity(q.e, p.e) AS s FROM v q JOIN v p ON q.package_name <> p.package_name AND p.label = 0),
y AS (SELECT * FROM x WHERE (s > 0.4 OR edits < 3) AND edits < 2 * length(query) // 3)
SELECT query, package_name, edits, round(s, 6) AS vector_similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY edits < 3 DESC, CASE WHEN edits < 3 THEN edits END NULLS LAST, s DESC NULLS LAST, package_name) AS place FROM y) WHERE place <= 10""")
def neighbors_flat_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vector-"), "vec_id").alias("package_name"), "embedding", "label")
    found = J.flat(rows, rows.filter("label = 0"), vector_over=0.4)
    return found.select("query", "package_name", F.col("edits").cast("long").alias("edits"), *six_digits("vector_similarity"), F.col("place").cast("long").alias("place"))


TWO = """SELECT query, package_name, edits, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY edits, package_name) AS place FROM (
SELECT q.n AS query, p.n AS package_name, levenshtein(lower(split_part(q.n, '{d}', {o})), lower(split_part(p.n, '{d}', {o}))) AS edits, q.n AS qn FROM g q JOIN g p
ON lower(split_part(q.n, '{d}', {s})) = lower(split_part(p.n, '{d}', {s})) AND lower(split_part(q.n, '{d}', {o})) <> lower(split_part(p.n, '{d}', {o})) AND q.n <> p.n)
WHERE {keep})"""


@query("WITH g AS (SELECT DISTINCT p_brand || ':' || p_name AS n FROM part) " + TWO.format(d=":", s=2, o=1, keep="edits < 4 AND edits < 2 * length(split_part(qn, ':', 1)) // 3"))
def neighbors_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat_ws(":", "p_brand", "p_name").alias("package_name")).distinct()
    return J.by_group(rows, rows, "maven").select("query", "package_name", F.col("edits").cast("long").alias("edits"), F.col("place").cast("long").alias("place"))


PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


@query("WITH g AS (SELECT DISTINCT 'example/' || regexp_extract(url, '([a-z]+)[.]example', 1) || '/' || regexp_extract(url, '/([a-z]+)/[0-9]', 1) AS n FROM pages) " + TWO.format(d="/", s=3, o=2, keep="edits < 4"))
def neighbors_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.concat_ws("/", F.lit("example"), F.regexp_extract("url", "([a-z]+)[.]example", 1), F.regexp_extract("url", "/([a-z]+)/[0-9]", 1)).alias("package_name")).distinct()
    return J.by_group(rows, rows, "golang").select("query", "package_name", F.col("edits").cast("long").alias("edits"), F.col("place").cast("long").alias("place"))


@query("WITH g AS (SELECT DISTINCT lower(p_brand) || '/' || replace(p_name, ' ', '-') AS n FROM part) " + TWO.format(d="/", s=2, o=1, keep="edits < 4 AND edits < 2 * length(split_part(qn, '/', 1)) // 3"))
def neighbors_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", F.lower("p_brand"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("package_name")).distinct()
    return J.by_group(rows, rows, "hf").select("query", "package_name", F.col("edits").cast("long").alias("edits"), F.col("place").cast("long").alias("place"))


VECTOR_GROUPS = """WITH v AS (SELECT {name} AS n, embedding[1:2]::DOUBLE[] AS a, embedding[3:4]::DOUBLE[] AS b FROM embeddings),
x AS (SELECT q.n AS query, p.n AS package_name, levenshtein(split_part(q.n, '/', {o}), split_part(p.n, '/', {o})) AS edits, list_cosine_similarity(q.a, p.a) AS s, list_cosine_similarity(q.b, p.b) AS t FROM v q JOIN v p ON split_part(q.n, '/', {s}) = split_part(p.n, '/', {s}) AND split_part(q.n, '/', {o}) <> split_part(p.n, '/', {o})),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY edits, t DESC, s DESC, package_name) AS place FROM x WHERE {keep})
SELECT query, package_name, edits, round(s, 6) AS author_similarity, round(t, 6) AS package_similarity, place FROM y"""


def vector_groups(spark: SparkSession, sf_dir: str, name: Column, kind: str) -> DataFrame:
    """Neighbours of vectors' names by group; the first two components stand for the author's vector, the next two for the package's."""
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(name.alias("package_name"), F.slice("embedding", 1, 2).alias("author_embedding"), F.slice("embedding", 3, 2).alias("package_embedding"))
    found = J.by_group(rows, rows, kind)
    return found.select("query", "package_name", F.col("edits").cast("long").alias("edits"), *six_digits("author_similarity", "package_similarity"), F.col("place").cast("long").alias("place"))


@query(VECTOR_GROUPS.format(name="'example/owner-' || md5(vec_id::VARCHAR)[1:8] || '/label' || label", o=2, s=3, keep="(s > 0.9 AND t > 0.99) OR edits < 4"))
def neighbors_path_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 8)
    return vector_groups(spark, sf_dir, F.concat(F.lit("example/owner-"), owner, F.lit("/label"), "label"), "golang")


@query(VECTOR_GROUPS.format(name="'organisation-' || md5(vec_id::VARCHAR)[1:8] || '/label' || label", o=1, s=2, keep="((s > 0.9 AND t > 0.99) OR edits < 4) AND edits < 2 * length(split_part(query, '/', 1)) // 3"))
def neighbors_author_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 8)
    return vector_groups(spark, sf_dir, F.concat(F.lit("organisation-"), owner, F.lit("/label"), "label"), "hf")


@query(VECTOR_GROUPS.replace("'/'", "':'").format(name="'org.m' || vec_id % 50 || '.' || md5(vec_id::VARCHAR)[1:8] || ':label' || label", o=1, s=2, keep="((s > 0.9 AND t > 0.99) OR edits < 4) AND edits < 2 * length(split_part(query, ':', 1)) // 3 AND split_part(query, '.', 2) <> split_part(package_name, '.', 2)"))
def neighbors_group_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("org.m"), F.col("vec_id") % 50, F.lit("."), F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 8))
    return vector_groups(spark, sf_dir, F.concat(group, F.lit(":label"), "label"), "maven")


@query("""WITH c AS (SELECT * FROM (VALUES (0,'install'),(1,'test'),(2,'run'),(3,'small ring'),(4,'red bolt'),(5,'red belt'),(6,'hot gear'),(7,'old golt')) t(i, c))
SELECT p_name AS query, min_by(c, i) AS command FROM (SELECT DISTINCT p_name FROM part) JOIN c ON levenshtein(lower(p_name), lower(c)) < 2 GROUP BY 1""")
def command_squat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("package_name")).distinct()
    return J.commands(rows, COMMANDS, "lev")


@query()
def fullscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    return D.full_scan(rows, P.popular(rows, "npm", top=20), "npm")


# words, names and namespaces


@query("SELECT DISTINCT url, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(url), '[-_ .~@/:]+', ' ', 'g'), '([0-9]+)', '\\1 ', 'g'), '\\s+'), lambda x: x <> ''), '|') AS words FROM pages")
def tokenise_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.array_join(N.tokens_served(F.col("url")), "|").alias("words")).distinct()


@query("SELECT DISTINCT url, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(url), '[-_ .~@/:]+', ' ', 'g'), '([0-9]+)', ' \\1 ', 'g'), '\\s+'), lambda x: x <> ''), '|') AS words FROM pages")
def tokenise_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.array_join(N.tokens_trained(F.col("url")), "|").alias("words")).distinct()


@query("SELECT DISTINCT c_name, lower(regexp_replace(c_name, '[-_.]+', '-', 'g')) AS normal, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS clean FROM customer")
def pypi_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_name", N.pypi_normal(F.col("c_name")).alias("normal"), N.cleaned(F.col("c_name")).alias("clean")).distinct()


@query(f"""WITH g AS (SELECT DISTINCT {PATH} AS n FROM pages) SELECT n, split_part(n, '/', 1) AS space, split_part(n, '/', 1) AS domain, split_part(n, '/', 2) AS package, array_to_string(string_split(n, '/')[3:], '/') AS rest FROM g""")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("n")).distinct()
    golang = F.lit("golang")
    x = g.select("n", N.namespace(F.col("n"), golang).alias("space"), N.name_parts(F.col("n"), golang).alias("x"))
    return x.select("n", "space", F.col("x.domain").alias("domain"), F.col("x.package").alias("package"), F.coalesce("x.rest", F.lit("")).alias("rest"))


@query("""WITH h AS (SELECT DISTINCT split_part(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', 1) AS a FROM pages)
SELECT x.a, y.a AS b, CASE WHEN x.a IN ('angular','angular-devkit','azure','babel','google','google-cloud','microsoft','nestjs','oxc-parser','oxc-resolver','react','typescript','vue','nolyfill','types') OR y.a IN ('angular','angular-devkit','azure','babel','google','google-cloud','microsoft','nestjs','oxc-parser','oxc-resolver','react','typescript','vue','nolyfill','types') THEN false ELSE levenshtein(x.a, y.a) < 3 END AS suspicious FROM h x JOIN h y ON x.a < y.a""")
def namespace_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select(F.split_part(F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.lit("."), F.lit(1)).alias("a")).distinct()
    trusted = F.array(*map(F.lit, TRUSTED_NAMESPACES["npm"]))
    pairs = h.join(h.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", S.suspicious_namespace(F.col("a"), F.col("b"), trusted, "lev").alias("suspicious"))


@query("SELECT DISTINCT p_brand AS space, p_name AS name, p_brand || '/' || p_name AS npm, p_brand || ':' || p_name AS maven, 'pkg:npm/' || p_brand || '/' || p_name AS purl, 'ruby' AS registry FROM part")
def full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, name = F.col("p_brand"), F.col("p_name")
    made = lambda r: N.full_name(F.lit(r), space, name).alias(r)
    return table(spark, sf_dir, "part").select(space.alias("space"), name.alias("name"), made("npm"), made("maven"), N.purl(F.lit("npm"), space, name).alias("purl"), N.registry_of(F.lit(" GEM")).alias("registry")).distinct()


# similarities


@query(f"""WITH {PAIRS}, d AS (SELECT *, levenshtein(a, b) AS d, greatest(length(a), length(b)) AS m FROM pairs)
SELECT a, b, d AS edits, round(CASE WHEN d < 3 THEN 1.0 ELSE 1 - d / m END, 6) AS edit, round(1 - d / m, 6) AS ratio FROM d""")
def sim_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    df = name_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"), S.edit_similarity(a, b, "lev").alias("edit"), S.edit_ratio(a, b, "lev").alias("ratio"))
    return df.select("a", "b", "edits", *six_digits("edit", "ratio"))


@query(f"""WITH {PAIRS}, g AS (SELECT a, substr(lower(a), i, 2) AS g, count(*) AS c FROM n, unnest(range(1, 40)) r(i) WHERE i < length(a) GROUP BY ALL),
s AS (SELECT a, sum(c) AS t FROM g GROUP BY a), b AS (SELECT p.a, p.b, sum(CASE WHEN y.c IS NULL THEN 0 ELSE least(x.c, y.c) END) AS o FROM pairs p LEFT JOIN g x ON x.a = p.a LEFT JOIN g y ON y.a = p.b AND y.g = x.g GROUP BY ALL)
SELECT b.a, b.b, round(o / (x.t + y.t - o), 6) AS bigram FROM b JOIN s x ON x.a = b.a JOIN s y ON y.a = b.b""")
def sim_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("a", "b", F.round(S.bigram_similarity(F.col("a"), F.col("b")), 6).alias("bigram"))


LOOKALIKE = " OR ".join(f"({x} LIKE '%{o}%' AND replace({x}, '{o}', '{n}') = {y})" for o, n in (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("7", "t"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("i", "l"), ("l", "i")) for x, y in (("a", "b"), ("b", "a")))


@query(f"""WITH {PAIRS} SELECT a, b, round(CASE WHEN {LOOKALIKE} THEN 1.0 WHEN starts_with(a, b) OR starts_with(b, a) THEN 1 - (length(a) - length(b)) / 100
WHEN length(a) = length(b) THEN 1 - hamming(a, b) / 100 ELSE 0 END, 6) AS lookalike FROM pairs""")
def sim_typosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("a", "b", F.round(S.lookalike_similarity(F.col("a"), F.col("b")), 6).alias("lookalike"))


@query(f"""WITH {PAIRS}, t AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pairs)
SELECT a, b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jaccard FROM t""")
def sim_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("a", "b", F.round(S.token_jaccard(N.tokens_trained(F.col("a")), N.tokens_trained(F.col("b"))), 6).alias("jaccard"))


@query()
def sim_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = S.six(F.col("a"), F.col("b"))
    df = name_pairs(spark, sf_dir).withColumns(measures)
    return df.withColumn("overall", S.greatest_number(*(F.col(c).cast("double") for c in measures)))


VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), vp AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS s, x.label = y.label AS same FROM v x JOIN v y ON x.vec_id < y.vec_id)"


#: Of arrays of cosines and edits; the columns' functions round() and tanh() took most of the time of a pair.
HYBRID = {
    "cosine": lambda s, e: pairwise.rounded(s),
    "hybrid": lambda s, e: pairwise.rounded(0.5 * s + 0.5 * e / 10),
    "tanh": lambda s, e: pairwise.rounded(0.4 * np.tanh(2 * s) + 0.6 * np.tanh(2 * np.abs(s))),
}


@query(f"WITH {VEC} SELECT a, b, round(s, 6) AS cosine, round(0.5 * s + 0.5 * levenshtein(a::VARCHAR, b::VARCHAR) / 10, 6) AS hybrid, round(0.4 * tanh(2 * s) + 0.6 * tanh(2 * abs(s)), 6) AS tanh FROM vp")
def sim_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.with_edits(table(spark, sf_dir, "embeddings"), measures=HYBRID)


# benignity


@query("""WITH f AS (SELECT o_orderkey AS k, k % 2 = 0 AS adv, k % 3 = 0 AS sus, k % 5 = 0 AS nr, k % 7 < 3 AS comp, k % 11 < 4 AS act, k % 13 = 0 AS obv, k % 17 = 0 AS fork, k % 19 = 0 AS test, k % 23 = 0 AS dist, k % 29 = 0 AS known, k % 31 = 0 AS ov, k % 37 = 0 AS rel FROM orders),
s AS (SELECT k, CASE WHEN adv THEN 8 ELSE 0 END + CASE WHEN sus AND NOT nr THEN 10 WHEN nr THEN 3 ELSE 0 END + CASE WHEN NOT comp THEN 2 ELSE 0 END - CASE WHEN act THEN 1 ELSE 0 END - CASE WHEN obv THEN 18 ELSE 0 END - CASE WHEN fork THEN 2 ELSE 0 END
- CASE WHEN test THEN 5 ELSE 0 END - CASE WHEN dist THEN 18 ELSE 0 END - CASE WHEN known AND NOT sus THEN 18 ELSE 0 END - CASE WHEN ov THEN 18 ELSE 0 END - CASE WHEN rel THEN 18 ELSE 0 END AS p FROM f)
SELECT k AS o_orderkey, greatest(0, least(10, p))::INTEGER AS risk_score, CASE WHEN greatest(0, least(10, p)) < 5 THEN 'Low' WHEN greatest(0, least(10, p)) < 8 THEN 'Medium' ELSE 'High' END AS risk_level, greatest(0, least(10, p)) < 5 AS is_false_positive FROM s""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = (k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 < 3, k % 11 < 4, k % 13 == 0, k % 17 == 0, k % 19 == 0, k % 23 == 0, k % 29 == 0, k % 31 == 0, k % 37 == 0)
    df = table(spark, sf_dir, "orders").select("o_orderkey", B.risk_score(*flags).alias("risk_score"))
    return df.withColumns({"risk_level": B.risk_level(F.col("risk_score")), "is_false_positive": B.is_benign(F.col("risk_score"))})


@query("""WITH s AS (SELECT l_partkey AS k, list_sort(list(DISTINCT l_suppkey)) AS people FROM lineitem GROUP BY 1)
SELECT x.k AS part, len(list_intersect(x.people, y.people)) AS shared, CASE WHEN len(y.people) > 3 THEN len(list_intersect(x.people, y.people)) >= 2 OR len(list_intersect(x.people, y.people)) / len(y.people) > 0.5 ELSE len(list_intersect(x.people, y.people)) >= 1 END AS overlap FROM s x JOIN s y ON y.k = x.k + 1""")
def overlap_maintainers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.collect_set("l_suppkey").alias("people"))
    t = s.select((F.col("part") - 1).alias("part"), F.col("people").alias("target"))
    return s.join(t, "part").select("part", F.size(F.array_intersect("people", "target")).cast("long").alias("shared"), B.overlapping(F.col("people"), F.col("target")).alias("overlap"))


@query("""SELECT event_id, floor((epoch(TIMESTAMP '2025-01-10') - floor(epoch(ts))) / 86400) <= 365 AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 5 AS active FROM events""")
def active_development(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = F.get_json_object("props", "$.k").cast("int")
    pushed = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", B.active(pushed, versions, F.lit("2025-01-10").cast("timestamp")).alias("active"))


@query("SELECT event_id, CASE WHEN value / 100 > 0.8 THEN event_type <> 'error' ELSE true END AS benign FROM events")
def command_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", B.command_verdict(F.col("value") / 100, F.col("event_type") != "error").alias("benign"))


@query("""WITH m AS (SELECT l_partkey AS package_id, list_sort(list(DISTINCT s_name)) AS u FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT p_partkey AS package_id, coalesce(array_to_string(u, '|'), '') AS users FROM part LEFT JOIN m ON package_id = p_partkey""")
def maintainers_left_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    people = people.select(F.col("l_partkey").alias("package_id"), F.col("s_name").alias("user"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("removed_at"))
    packages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("package_id"))
    return K.active_maintainers(packages, people).select("package_id", F.array_join("users", "|").alias("users"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.doc, b.doc) AS doc FROM (SELECT o_custkey AS k, max(nullif(o_orderpriority, '5-LOW')) AS doc FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, c_mktsegment AS doc FROM customer) b ON a.k = b.k")
def doc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("doc"))
    return K.first_filled(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("doc")), "k", "doc")


# evaluation


RATIOS = "coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r"
FULL = "tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS fnr"
COUNTS = "count(*) FILTER (WHERE t AND h) AS tp, count(*) FILTER (WHERE NOT t AND h) AS fp, count(*) FILTER (WHERE NOT t AND NOT h) AS tn, count(*) FILTER (WHERE t AND NOT h) AS fn"
RATES = ("precision", "recall", "f1", "accuracy", "specificity", "fpr", "fnr")
CELLS = ("tp", "fp", "tn", "fn")


@query(f"WITH c AS (SELECT {COUNTS} FROM (SELECT toxic = 1 AS t, quality = 0 AS h FROM labels)), d AS (SELECT *, {RATIOS} FROM c) SELECT {FULL} FROM d")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("t"), (F.col("quality") == 0).alias("h"))
    return E.confusion(df, "t", "h").select(*CELLS, *six_digits(*RATES))


@query(f"WITH x AS (SELECT lang, toxic = 1 AS t, quality = 0 AS h FROM labels JOIN documents USING (doc_id)), c AS (SELECT coalesce(lang, 'all') AS lang, {COUNTS} FROM x GROUP BY GROUPING SETS ((lang), ())), d AS (SELECT *, {RATIOS} FROM c) SELECT lang, {FULL} FROM d")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    df = df.select("lang", (F.col("toxic") == 1).alias("t"), (F.col("quality") == 0).alias("h"))
    return E.confusion(df, "t", "h", ["lang"], overall=True).select(F.coalesce("lang", F.lit("all")).alias("lang"), *CELLS, *six_digits(*RATES))


@query("SELECT trim(x) AS category, count(*) AS n FROM (SELECT unnest(string_split(p_type || ', ' || p_brand, ',')) AS x FROM part) GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.category_counts(table(spark, sf_dir, "part").select(F.concat_ws(", ", "p_type", "p_brand").alias("x")), "x")


LABEL = "CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN 'Unknown' END"


@query(f"SELECT *, round(100.0 * yes / (yes + no), 6) AS yes_percent FROM (SELECT count(*) FILTER (WHERE l = 'yes') AS yes, count(*) FILTER (WHERE l = 'no') AS no, count(*) FILTER (WHERE coalesce(l, '') = '') AS missing, count(*) FILTER (WHERE l LIKE '%unk%') AS unknown FROM (SELECT lower({LABEL}) AS l FROM orders))")
def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.expr(LABEL).alias("l"))
    return E.label_tally(df, "l").select("yes", "no", "missing", "unknown", *six_digits("yes_percent"))


@query(f"SELECT CASE WHEN lower({LABEL}) = 'yes' THEN 'benign' ELSE 'stealthy' END AS category, count(*) AS n FROM orders WHERE lower({LABEL}) IN ('yes', 'no') GROUP BY 1")
def label_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(E.label_category(F.expr(LABEL)).alias("category"))
    return df.filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'stealthy' ELSE 'active' END AS category, CASE WHEN event_type = 'error' THEN 'TP (Missing Metadata)' WHEN value > 50 THEN 'TP' ELSE 'FP' END AS status FROM events")
def threat_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    threat = F.when(F.col("event_type") == "view", "false_positive").when(F.col("event_type") == "click", "typosquat").otherwise(F.col("event_type"))
    found = F.when(F.col("value") > 50, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", E.threat_category(threat).alias("category"), E.detection_status(F.col("event_type") == "error", found).alias("status"))


@query("SELECT * FROM (SELECT 'big' AS flag, count(*) FILTER (WHERE p_size > 25) AS n FROM part UNION ALL SELECT 'dear', count(*) FILTER (WHERE p_retailprice > 950) FROM part UNION ALL SELECT 'economy', count(*) FILTER (WHERE p_type = 'ECONOMY') FROM part)")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("big"), (F.col("p_retailprice") > 950).alias("dear"), (F.col("p_type") == "ECONOMY").alias("economy"))
    return E.flag_counts(df, ["big", "dear", "economy"])


@query("SELECT p_type AS category, count(*) AS n, round(avg(CASE WHEN p_type = 'ECONOMY' THEN (p_size > 25)::INTEGER ELSE (NOT p_size > 40)::INTEGER END), 6) AS rate FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') GROUP BY 1")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_type", (F.col("p_size") > 25).alias("big"), (F.col("p_size") > 40).alias("huge"))
    return E.match_rates(df, "p_type", {"ECONOMY": ("big", False), "STANDARD": ("huge", True)}).select("category", "n", *six_digits("rate"))


@query("SELECT round(avg(value) * 1000, 6) AS mean_ms, round(median(value) * 1000, 6) AS median_ms, count(value) AS packages, round(sum(value), 6) AS total_s, round(count(value) / sum(value), 6) AS throughput FROM events")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency(table(spark, sf_dir, "events"), "value").select(*six_digits("mean_ms", "median_ms"), "packages", *six_digits("total_s", "throughput"))


@query("SELECT p_brand AS package, bool_or(p_size > 45) AS flagged FROM part GROUP BY 1")
def flagged_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.flagged(table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), (F.col("p_size") <= 45).alias("fp")), "package", "fp")


@query("""WITH x AS (SELECT l_orderkey AS package, l_linenumber AS place, l_returnflag <> 'R' AS hit FROM lineitem), y AS (SELECT *, max(CASE WHEN place = 1 THEN hit::INTEGER END) OVER (PARTITION BY package) AS f FROM x)
SELECT package, bool_or(hit) AS detected, count(*) AS neighbours FROM y WHERE place <= 3 AND NOT (place = 2 AND coalesce(f, 0) = 1) GROUP BY 1""")
def package_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), F.col("l_linenumber").alias("place"), (F.col("l_returnflag") == "R").alias("fp"))
    return E.package_verdict(df, "package", "place", "fp")


@query("""WITH t AS (SELECT lower(trim(o_orderpriority)) || o_custkey % 100 AS k, arg_max(o_orderstatus, o_orderkey) AS truth FROM orders GROUP BY 1), o AS (SELECT lower(trim(c_mktsegment)) || c_custkey % 100 AS k, c_custkey FROM customer)
SELECT t.k AS match_key, truth, said FROM t JOIN (SELECT '1-urgent' || c_custkey % 100 AS k, arg_max(c_mktsegment, c_custkey) AS said FROM customer GROUP BY 1) u ON u.k = t.k""")
def truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", (F.col("o_custkey") % 100).cast("string")).alias("name"), F.col("o_orderstatus").alias("truth"), F.col("o_orderkey").alias("at"))
    said = table(spark, sf_dir, "customer").select(F.concat(F.lit(" 1-URGENT"), (F.col("c_custkey") % 100).cast("string")).alias("name"), F.col("c_mktsegment").alias("said"), F.col("c_custkey").alias("at"))
    return E.truth_and_output(truth.withColumn("name", F.lower("name")), said, "name", "at").select("match_key", "truth", "said")


@query("SELECT c_custkey, coalesce(n > 0, false) AS detected, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def detected_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(hits, "c_custkey", "left").select("c_custkey", F.col("n").isNotNull().alias("detected"), F.coalesce("n", F.lit(0)).alias("n"))


SWEEP = "WITH {vec}, k AS (SELECT unnest(range(0, 101)) AS k), c AS (SELECT k, count(*) FILTER (WHERE same AND floor(s / 0.01 + 1e-9) >= k) AS tp, count(*) FILTER (WHERE NOT same AND floor(s / 0.01 + 1e-9) >= k) AS fp, count(*) FILTER (WHERE NOT same AND floor(s / 0.01 + 1e-9) < k) AS tn, count(*) FILTER (WHERE same AND floor(s / 0.01 + 1e-9) < k) AS fn FROM vp, k GROUP BY k), d AS (SELECT *, {ratios} FROM c)"


@query("WITH a AS (SELECT quality AS s, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS n FROM labels GROUP BY 1) SELECT s, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY s DESC) / sum(n) OVER (), 6) AS fpr FROM a")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").select(F.col("quality").alias("s"), (F.col("toxic") == 1).alias("t"))
    return E.roc(df, "t", "s").select("s", *six_digits("tpr", "fpr"))


@query(SWEEP.format(vec=VEC, ratios=RATIOS) + f" SELECT round(k * 0.01, 6) AS threshold, {FULL} FROM d")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = pairwise.counted(table(spark, sf_dir, "embeddings"), lambda s: np.floor(s / 0.01 + 1e-9), -101, 101)
    return E.sweep_counts(levels, "level").select("threshold", *CELLS, *six_digits(*RATES))


@query(SWEEP.format(vec=VEC, ratios=RATIOS) + f" SELECT * FROM (SELECT round(k * 0.01, 6) AS threshold, {FULL} FROM d) ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_by(threshold_sweep(spark, sf_dir), "f1", "threshold")


@query(f"WITH {VEC}, c AS (SELECT round(s, 6) AS s, count(*) FILTER (WHERE same)::DOUBLE AS p, count(*) FILTER (WHERE NOT same)::DOUBLE AS n FROM vp GROUP BY 1), d AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM c) SELECT round(sum(p * (less + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM d")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = pairwise.counted(table(spark, sf_dir, "embeddings"), lambda s: np.rint(s * 1e6), -1_000_001, 1_000_001)
    return E.auc_counts(levels, "level").select(*six_digits("auc"))


@query(f"""WITH {VEC}, k AS (SELECT unnest(range(0, 11)) AS k), x AS (SELECT k, same AS t, s * (k * 0.1::DOUBLE) + (1 - levenshtein(a::VARCHAR, b::VARCHAR) / 5) * (1 - k * 0.1::DOUBLE) >= 0.3 - 1e-12 AS h FROM vp, k),
c AS (SELECT k, {COUNTS} FROM x GROUP BY k), d AS (SELECT *, {RATIOS} FROM c) SELECT round(k * 0.1::DOUBLE, 1) AS weight, {FULL} FROM d ORDER BY f1 DESC, weight LIMIT 3""")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.with_ratios(pairwise.weights(table(spark, sf_dir, "embeddings"), 0.3)).withColumn("weight", F.round(F.col("k") * 0.1, 1))
    return found.select("weight", *CELLS, *six_digits(*RATES)).orderBy(F.col("f1").desc(), "weight").limit(3)


@query(f"WITH {VEC} SELECT a, b, round(s, 6) AS s FROM vp WHERE s < -0.3 ORDER BY vp.s")
def low_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.ordered_pairs(table(spark, sf_dir, "embeddings"), -0.3).select("a", "b", F.round("s", 6).alias("s"))


# tables


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS updated_at, min(event_id) AS created_at FROM events GROUP BY 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("updated_at"), F.col("event_id").alias("created_at"))
    return K.upsert(rows.filter("event_type <> 'error'"), rows.filter("event_type = 'error'"), "user_id")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return K.insert_ignore(there, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def anti_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return K.unprocessed(e.select("event_id", "user_id"), e.filter("event_type = 'error' AND value > 90"), "user_id")


@query("SELECT name, row_number() OVER (ORDER BY l, p, name) AS place FROM (SELECT name, l, p FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY l, p) AS n FROM (SELECT p_name AS name, 0 AS l, p_partkey AS p FROM part WHERE p_size > 40 UNION ALL SELECT p_name, 1, p_partkey FROM part)) WHERE n = 1 ORDER BY l, p, name LIMIT 50)")
def dedupe_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place"), "p_size")
    return K.first_distinct([one.filter("p_size > 40"), one], "name", 50).withColumn("place", F.col("place").cast("long"))


@query("SELECT p_type AS registry, count(DISTINCT p_name) AS n, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS names FROM part GROUP BY 1")
def names_per_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("registry")).agg(F.countDistinct("p_name").alias("n"), F.array_join(F.sort_array(F.collect_set("p_name")), "|").alias("names"))


@query("WITH b AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, count(*) FILTER (WHERE ts < t) AS earlier FROM b JOIN events USING (user_id) GROUP BY 1")
def releases_before_first_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return releases.before_first_bad(e, e.filter("event_type = 'error'"), "user_id", "ts").select("user_id", "earlier")


@query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def first_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.first_uploads(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("""SELECT 'p' || o_orderkey AS input, 't' || o_custkey AS target, o_orderpriority AS category, round(o_orderkey % 60 + 0.5, 6) AS seconds FROM orders""")
def parse_tool_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.format_string("('t%s', 'p%s'): {'p%s': '%s'}, 0:00:%s.500000", F.col("o_custkey"), k, k, F.col("o_orderpriority"), F.lpad((k % 60).cast("string"), 2, "0"))
    x = table(spark, sf_dir, "orders").select(readers.tool_line(line).alias("x"))
    return x.select("x.input", "x.target", "x.category", F.round("x.seconds", 6).alias("seconds"))


@query("SELECT event_id, event_type AS type, 'n' || user_id AS name FROM events")
def feed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.lit("n"), "user_id").alias("name"))).alias("artifact"))
    return readers.feed_artifacts(raw).select("event_id", "type", "name")


# vectors


@query("""WITH s AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 127 AS scale FROM embeddings) SELECT vec_id, array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE / scale, 0)::INTEGER), ',') AS q FROM embeddings, s""")
def quantise_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scale = vectors.int8_scale(e).first().scale
    return e.select("vec_id", F.array_join(F.transform(vectors.quantised(F.col("embedding"), F.lit(scale)), lambda x: x.cast("string")), ",").alias("q"))


@query("""WITH w AS (SELECT DISTINCT p_name AS n, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT n AS package_name, round(avg(length(w)::DOUBLE), 6) AS x, round(avg(ascii(w)::DOUBLE), 6) AS y FROM w GROUP BY 1""")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(F.col("p_name").alias("package_name"))
    words = named.select(F.explode(N.tokens_served(F.col("package_name"))).alias("word")).distinct()
    words = words.withColumn("vector", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")))
    out = vectors.pooled(named, words, 2)
    return out.select("package_name", F.round(F.get("embedding", F.lit(0)), 6).alias("x"), F.round(F.get("embedding", F.lit(1)), 6).alias("y"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5) AS similarity FROM embeddings")
def vectors_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text and read again."""
    v = vectors.parsed(vectors.written(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(S.cosine(F.col("v"), F.reverse("v")), 5).alias("similarity"))


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hashed(table(spark, sf_dir, "part").select(F.col("p_name").alias("package_name")).distinct())


@query()
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(F.col("p_name").alias("package_name"))
    return vectors.sampled_negatives(named, name_pairs(spark, sf_dir).filter(F.levenshtein("a", "b") < 3), 200)


FORMS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MMM d, yyyy hh:mm:ss a", "yyyy/MM/dd HH:mm:ss", "dd MMMM yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss")


@query("WITH e AS (SELECT user_id, event_type, date_trunc('second', ts) AS ts FROM events), b AS (SELECT user_id, min(ts) AS t FROM e WHERE event_type = 'error' GROUP BY 1) SELECT user_id, count(*) FILTER (WHERE ts < t) AS earlier FROM b JOIN e USING (user_id) GROUP BY 1")
def releases_in_any_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in seven forms."""
    written = F.lit(None).cast("string")
    for k, form in enumerate(FORMS):
        written = F.when(F.col("event_id") % len(FORMS) == k, F.date_format(F.col("ts").cast("timestamp"), form)).otherwise(written)
    e = table(spark, sf_dir, "events").select("user_id", "event_type", written.alias("ts"))
    return releases.before_first_bad(e, e.filter("event_type = 'error'"), "user_id", "ts").select("user_id", "earlier")


@query(f"""WITH r AS (SELECT doc_id, toxic = 1 AS t, n_chars % 1000 / 1000 AS s FROM labels JOIN documents USING (doc_id)), n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM r GROUP BY t)),
x AS (SELECT t, s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY md5('42:' || doc_id), doc_id) AS place FROM r), n WHERE place <= n),
c AS (SELECT k, count(*) FILTER (WHERE t AND floor(s / 0.01 + 1e-9) >= k) AS tp, count(*) FILTER (WHERE NOT t AND floor(s / 0.01 + 1e-9) >= k) AS fp, count(*) FILTER (WHERE NOT t AND floor(s / 0.01 + 1e-9) < k) AS tn, count(*) FILTER (WHERE t AND floor(s / 0.01 + 1e-9) < k) AS fn FROM x, unnest(range(10, 96, 5)) u(k) GROUP BY k), d AS (SELECT *, {RATIOS} FROM c)
SELECT * FROM (SELECT round(k * 0.01, 6) AS threshold, {FULL} FROM d) ORDER BY f1 DESC, threshold LIMIT 1""")
def balanced_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 18 thresholds over as many rows of either class."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("doc_id", (F.col("toxic") == 1).alias("t"), (F.col("n_chars") % 1000 / 1000).alias("s"))
    found = E.sweep(E.balanced(rows, "t", "doc_id"), "t", "s", 10, 95, 5)
    return E.best_by(found.select("threshold", *CELLS, *six_digits(*RATES)), "f1", "threshold")


ORIGINS = ("npm", "pypi", "maven", "nuget", "ruby", "golang", "hf")


def catalog_by_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages, in files apart by registry."""
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/packages-{uuid.uuid4().hex}"
    registry = F.element_at(F.array(*map(F.lit, ORIGINS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(registry.alias("registry"), F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_partkey").alias("package_name"), F.col("p_type").alias("doc"), F.col("p_partkey").alias("id"))
    sinks.write_catalog(rows, path)
    return spark.read.parquet(path)


NAMED = "r AS (SELECT ['npm', 'pypi', 'maven', 'nuget', 'ruby', 'golang', 'hf'][p_partkey % 7 + 1] AS registry, replace(p_name, ' ', '-') || '-' || p_partkey AS package_name, p_type AS doc, p_partkey AS id FROM part)"


@query(f"WITH {NAMED} SELECT r.package_name, doc, p_brand AS description, lower(p_type) AS summary, p_size::VARCHAR AS owners FROM r LEFT JOIN (SELECT *, replace(p_name, ' ', '-') || '-' || p_partkey AS package_name FROM part WHERE p_size > 20) n ON n.package_name = r.package_name WHERE registry = 'nuget'")
def nuget_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nuget = table(spark, sf_dir, "part").filter("p_size > 20").select(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_partkey").alias("package_name"), F.col("p_brand").alias("description"), F.lower("p_type").alias("summary"), F.col("p_size").cast("string").alias("owners"))
    return documents.nuget_documents(catalog_by_registry(spark, sf_dir), nuget)


@query("SELECT p_brand || ':' || p_name || '-' || p_partkey AS package_name, l_linestatus AS description, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = 1 GROUP BY 1, 2")
def maven_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group_id"), F.concat_ws("-", "p_name", "p_partkey").alias("artifact_id"))
    artifacts = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("id"), F.col("l_linestatus").alias("raw_index"))
    return documents.maven_descriptions(packages, artifacts).groupBy("package_name", "description").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NAMED} SELECT registry, package_name, doc FROM r WHERE registry IN ('npm', 'hf') AND id % 5 = 0")
def requested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = catalog_by_registry(spark, sf_dir)
    asked = catalog.filter("id % 5 = 0 and registry in ('npm', 'hf')").select("registry", F.upper("package_name").alias("package_name"))
    return documents.requested(catalog, asked).select("registry", "package_name", "doc")


SERVED = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower({x}), '[-_ .~@/:]+', ' ', 'g'), '([0-9]+)', '\\1 ', 'g'), '\\s+'), lambda y: y <> '')"


def three_sql(name: str, author: str, package: str) -> str:
    """DuckDB SQL of three vectors of length 2: letters and first letter of the words that have an even number of letters, zeros for others."""
    each = "coalesce(list_avg(list_transform({w}, lambda y: CASE WHEN length(y) % 2 = 0 THEN {v} ELSE 0 END)), 0)"
    columns = ", ".join(f"round({each.format(w=SERVED.format(x=part), v=v)}, 6) AS {kind}_{c}" for kind, part in (("embedding", "n"), ("author", author), ("package", package)) for c, v in (("x", "length(y)::DOUBLE"), ("y", "ascii(y)::DOUBLE")))
    return f"WITH g AS (SELECT DISTINCT {name} AS n FROM part) SELECT n AS package_name, {columns} FROM g"


def three(spark: SparkSession, sf_dir: str, name: Column, registry: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(name.alias("package_name")).distinct()
    words = named.select(F.explode(N.tokens_served(F.col("package_name"))).alias("word")).distinct().filter(F.length("word") % 2 == 0)
    found = vectors.three_vectors(named, words.withColumn("vector", F.array(F.length("word").cast("double"), F.ascii("word").cast("double"))), 2, registry)
    pick = lambda kind, c: [F.round(F.get(c, F.lit(i)), 6).alias(f"{kind}_{x}") for i, x in enumerate("xy")]
    return found.select("package_name", *pick("embedding", "embedding"), *pick("author", "author_embedding"), *pick("package", "package_embedding"))


@query(three_sql("lower(p_brand) || '.' || p_size % 7 || ':' || replace(p_name, ' ', '-')", "split_part(n, ':', 1)", "split_part(n, ':', 2)"))
def three_vectors_maven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three(spark, sf_dir, F.concat(F.lower("p_brand"), F.lit("."), F.col("p_size") % 7, F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("-"))), "maven")


GO_NAME = "CASE p_size % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'example.org/' || replace(p_name, ' ', '-') ELSE 'github.com/' || lower(p_brand) || '/' || replace(p_name, ' ', '_') || '/v' || p_size % 5 END"


@query(three_sql(GO_NAME, "CASE WHEN len(string_split(n, '/')) > 2 THEN split_part(n, '/', 2) ELSE split_part(n, '/', 1) END", "CASE WHEN len(string_split(n, '/')) > 2 THEN array_to_string(string_split(n, '/')[3:], '/') ELSE split_part(n, '/', 2) END"))
def three_vectors_golang(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.concat(F.lit("example.org/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    long = F.concat(F.lit("github.com/"), F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/v"), F.col("p_size") % 5)
    return three(spark, sf_dir, F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).when(F.col("p_size") % 3 == 1, short).otherwise(long), "golang")


@query(three_sql("CASE WHEN p_size % 4 = 0 THEN p_name ELSE lower(p_brand) || '/' || replace(p_name, ' ', '-') || CASE WHEN p_size % 4 = 1 THEN '/sub' ELSE '' END END", "CASE WHEN n LIKE '%/%' THEN split_part(n, '/', 1) ELSE '' END", "CASE WHEN n LIKE '%/%' THEN array_to_string(string_split(n, '/')[2:], '/') ELSE n END"))
def three_vectors_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 4 == 1, "/sub").otherwise(""))
    return three(spark, sf_dir, F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(full), "hf")


@query()
def subword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors trained on part names, customers, suppliers and paths of pages; held against a plain decomposition in the tests."""
    one = lambda t, c: table(spark, sf_dir, t).select(c.alias("package_name"))
    named = one("part", F.concat_ws("/", "p_brand", "p_name")).unionByName(one("customer", F.col("c_mktsegment"))).unionByName(one("pages", F.regexp_extract("url", "^https?://([^?#]*)", 1))).distinct()
    return subwords.name_vectors(named, subwords.train(named))


@query()
def projected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.projected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# files, feeds and rules


def folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_type || ':' || p_name || '-' || p_partkey AS package_name FROM part")
def names_of_a_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a CSV with groups and artifacts, its values quoted where they have to be."""
    path = folder(spark, "dump")
    sinks.write_csv(table(spark, sf_dir, "part").select(F.col("p_type").alias("group_id"), F.concat_ws("-", "p_name", "p_partkey").alias("artifact_id")), path)
    return readers.names(readers.csv(spark, path)).select("package_name")


@query("SELECT DISTINCT 'a, \"' || p_name || '\"' AS package_name FROM part WHERE p_size > 3")
def distinct_names_of_a_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with commas and quotes; rows with a null are left out."""
    path = folder(spark, "dump")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit('a, "'), "p_name", F.lit('"')).alias("package_name"), F.when(F.col("p_size") > 3, F.col("p_size")).alias("size"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.distinct_names(readers.csv(spark, path))


@query("SELECT p_name || '#' || p_partkey AS package_name, p_retailprice AS popularity FROM part WHERE p_retailprice IS NOT NULL ORDER BY 2 DESC")
def popular_list_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "popular")
    sinks.write_csv(table(spark, sf_dir, "part").filter("p_retailprice is not null").select(F.concat_ws("#", "p_name", "p_partkey").alias("package_name"), F.col("p_retailprice").alias("popularity")), path)
    return readers.popular_list(spark, path)


@query("SELECT DISTINCT c_name AS package_name FROM customer UNION SELECT DISTINCT s_name FROM supplier")
def first_columns_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder whose files differ in their headers."""
    path = folder(spark, "folder")
    table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").coalesce(1).write.option("header", True).mode("append").csv(path)
    table(spark, sf_dir, "supplier").select("s_name", "s_acctbal").coalesce(1).write.option("header", True).mode("append").csv(path)
    return readers.first_columns(spark, path)


@query("SELECT doc_id, 'n' || doc_id AS typosquat_pkg, lang AS legitimate_pkg, source FROM documents WHERE doc_id % 3 <> 0 AND lang <> '' AND trim(source) <> '' AND doc_id % 5 NOT IN (0, 1)")
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made_up = F.when(F.col("doc_id") % 5 == 0, " Yes").when(F.col("doc_id") % 5 == 1, "TRUE").when(F.col("doc_id") % 5 == 2, "no")
    name = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("n"), "doc_id")).when(F.col("doc_id") % 2 == 0, " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("typosquat_pkg"), F.col("lang").alias("legitimate_pkg"), "source", made_up.alias("hallucianated"))
    return readers.positive_pairs(rows).drop("hallucianated")


@query("SELECT user_id, event_id::VARCHAR AS version, min(strftime(ts, '%Y-%m-%d')) AS time, event_type AS kind FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 4")
def release_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases from the JSON that two registries tell of a package."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'view')").select("user_id", "event_type", F.col("event_id").cast("string").alias("v"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("t"))
    of = lambda kind: e.filter(F.col("event_type") == kind).groupBy("user_id")
    npm = of("click").agg(F.to_json(F.struct(F.map_from_entries(F.concat(F.collect_list(F.struct("v", "t")), F.array(F.struct(F.lit("created").alias("v"), F.lit("x").alias("t"))))).alias("time"))).alias("doc"))
    gems = of("view").agg(F.to_json(F.collect_list(F.struct(F.col("v").alias("number"), F.col("t").alias("created_at")))).alias("doc"))
    read = lambda df, registry, kind: df.select("user_id", F.explode(readers.releases(F.col("doc"), registry)).alias("x")).select("user_id", "x.version", "x.time", F.lit(kind).alias("kind"))
    return read(npm, "npm", "click").unionByName(read(gems, "ruby", "view"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS package, 'distance ' || p_size AS reasons FROM part WHERE p_size % 2 = 0")
def squat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tool's log tells; other lines tell nothing."""
    said = F.format_string("2024-01-01 INFO - %s package exists. Potential squat. [distance %s]", F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size"))
    line = F.when(F.col("p_size") % 2 == 0, said).otherwise(F.concat(F.lit("INFO - checking "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", readers.squat_line(line).alias("x")).filter("x is not null").select("p_partkey", "x.package", "x.reasons")


@query("SELECT event_id FROM events WHERE event_id % 4 <> 1 AND event_id % 4 <> 3")
def known_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("typo"), F.lit(" unk "), F.lit(None).cast("string"), F.lit("UNK")), (F.col("event_id") % 4 + 1).cast("int"))
    return readers.not_unknown(table(spark, sf_dir, "events").select("event_id", said.alias("confusion"))).select("event_id")


@query("SELECT vec_id, round(CASE vec_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])) END, 6) AS similarity FROM embeddings")
def finite_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines with vectors of which some are null, infinite or not numbers: 0."""
    e = F.col("embedding").cast("array<double>")
    odd = lambda x: F.concat(F.slice(e, 1, F.size(e) - 1), F.array(F.lit(float(x))))
    spoilt = F.when(F.col("vec_id") % 5 == 1, odd("nan")).when(F.col("vec_id") % 5 == 2, odd("inf")).when(F.col("vec_id") % 5 > 2, e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.cosine(spoilt, F.reverse(e)), 6).alias("similarity"))


@query("SELECT s_name AS package_name, s_acctbal AS popularity FROM supplier ORDER BY 2, 1 LIMIT 30")
def popular_topn_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("package_name"), F.col("s_acctbal").alias("popularity"))
    return P.popular(rows, "golang", top=30)


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'npm' WHEN 1 THEN 'maven' WHEN 2 THEN 'pypi' WHEN 3 THEN 'ruby' WHEN 4 THEN 'golang' WHEN 5 THEN 'hf' WHEN 6 THEN 'nuget' WHEN 7 THEN 'unknown' ELSE 'npm' END AS registry FROM part""")
def registries_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("npm", "Maven", "PYPI", "ruby", "golang", "hf", "nuget", "cargo", "pypi-npm")))
    name = F.concat_ws("_", F.lit("dump"), F.element_at(kinds, (F.col("p_partkey") % 9 + 1).cast("int")), F.lit("names.csv"))
    return table(spark, sf_dir, "part").select("p_partkey", N.registry_named(name).alias("registry"))


@query("""WITH x AS (SELECT p_partkey AS k, p_name AS query, CASE WHEN p_partkey % 11 = 0 THEN 'ab' ELSE p_type END || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '' || p_size END AS package_name, p_size AS rank FROM part),
v AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, k) AS choice FROM x WHERE length(package_name) >= 3 AND k % 7 <> 0) SELECT query, package_name, k, choice FROM v WHERE choice <= 2""")
def valid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of a name's neighbours; unknown similarities and short names are none."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("query"), F.when(F.col("p_partkey") % 11 == 0, "ab").otherwise(F.concat("p_type", "p_size")).alias("package_name"), F.struct("p_size", "p_partkey").alias("rank"), F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(0.9).alias("overall"))
    return J.valid(rows, "pypi").select("query", "package_name", "k", F.col("choice").cast("long").alias("choice"))


@query("SELECT p_partkey FROM part WHERE p_size % 4 <> 0")
def allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names left when those of trusted namespaces are out."""
    spaces = F.array(*map(F.lit, ("google", "gooogle", "@googled", "x")))
    name = F.concat_ws("/", F.concat(F.lit("@"), F.element_at(spaces, (F.col("p_size") % 4 + 1).cast("int"))), F.replace("p_name", F.lit(" "), F.lit("-")))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("package_name"))
    return D.untrusted(rows, "npm").select("p_partkey")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def written_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by group, written as JSON and as CSV, read again and joined."""
    one, other = folder(spark, "metrics"), folder(spark, "stats")
    stats = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    sinks.write_json(stats.select("lang", "n"), one)
    sinks.write_csv(stats.select("lang", "mean"), other)
    means = readers.csv(spark, other, "name string, mean double")
    return spark.read.schema("lang string, n long").json(one).join(means, F.col("lang").eqNullSafe(F.col("name"))).select("lang", "n", *six_digits("mean"))


@query(f"WITH {NAMED} SELECT registry, package_name FROM r WHERE registry = 'maven'")
def saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry of a catalog's table, which is dropped again when it is read."""
    name = f"packages_{uuid.uuid4().hex}"
    sinks.save_table(catalog_by_registry(spark, sf_dir), name, folder(spark, "table"))
    found = cut(spark.table(name).filter("registry = 'maven'").select("registry", "package_name"))
    sinks.drop_table(spark, name)
    return found


@query(f"WITH {PARTS}, m AS (SELECT DISTINCT p_type AS package_name, 9999999.0::DOUBLE AS popularity, 0 AS o FROM part WHERE p_type NOT IN (SELECT package_name FROM listed) UNION ALL SELECT *, 1 FROM listed) SELECT package_name, row_number() OVER (ORDER BY o, popularity DESC, package_name) AS place FROM m")
def merged_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged list's order, as it is written."""
    merged = P.with_targets(listed(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_type").alias("package_name")), "npm")
    path = folder(spark, "merged")
    sinks.write_csv(merged.coalesce(1), path)
    rows = readers.csv(spark, path).select("package_name", F.monotonically_increasing_id().alias("at"))  # one file, in its order
    return K.first_distinct([rows.withColumnRenamed("at", "place")], "package_name", 1_000_000).withColumn("place", F.col("place").cast("long"))


@query("""SELECT DISTINCT p_brand, p_name, 'github' AS kind, lower(p_brand) AS grp, replace(p_name, ' ', '_') AS package FROM part""")
def split_github_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", F.lit("github.com"), "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("v2"))
    x = table(spark, sf_dir, "part").select("p_brand", "p_name", N.name_parts(name, F.lit("golang")).alias("x")).distinct()
    return x.select("p_brand", "p_name", "x.kind", F.col("x.group").alias("grp"), "x.package")


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 < 3 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 > 2 THEN 1 ELSE 0 END) >= 3 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS comprehensive FROM orders")
def comprehensive_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    filled = lambda c: F.when(c, "x").otherwise(F.when(k % 4 == 0, ""))
    people = F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    flag = B.comprehensive(filled(k % 2 == 0), people, filled(k % 5 < 3), filled(k % 7 > 2), k % 11 != 0, k % 13 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", flag.alias("comprehensive"))


#: Alignment distance row by row; a state holds the row before the last and the last.
OSA = """list_reduce(list_prepend({{'p': [0], 'r': range(0, len({b}) + 1)}}, list_transform(range(1, len({a}) + 1), lambda i: {{'p': [i], 'r': [i]}})),
 lambda s, e: {{'p': s.r, 'r': list_reduce(list_prepend([e.p[1]], list_transform(range(1, len({b}) + 1), lambda j: [j])), lambda w, j: list_append(w,
 least(s.r[j[1] + 1] + 1, w[j[1]] + 1, s.r[j[1]] + CASE WHEN {a}[e.p[1]] = {b}[j[1]] THEN 0 ELSE 1 END,
 CASE WHEN e.p[1] > 1 AND j[1] > 1 AND {a}[e.p[1]] = {b}[j[1] - 1] AND {a}[e.p[1] - 1] = {b}[j[1]] THEN s.p[j[1] - 1] + 1 ELSE 1000000 END)))}}).r[-1]"""


@query(f"""WITH n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_name[2] || p_name[1] || p_name[3:] WHEN p_size % 3 = 1 THEN p_name ELSE p_name[1:3] || p_name[5] || p_name[4] || p_name[6:] END AS a FROM part), pairs AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a <> y.a),
d AS (SELECT a, b, {OSA.format(a='a', b='b')} AS d, greatest(length(a), length(b)) AS m FROM pairs) SELECT a, b, d AS edits, round(CASE WHEN d < 3 THEN 1.0 ELSE 1 - d / m END, 6) AS edit, round(1 - d / m, 6) AS ratio, CASE WHEN d < 3 THEN 1.0 ELSE 0.0 END AS space FROM d""")
def sim_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default measure, swaps as one edit, over names with swapped letters."""
    n, size = F.col("p_name"), F.col("p_size")
    part = lambda i, k: F.substring(n, i, k)
    odd = F.when(size % 3 == 0, F.concat(part(2, 1), part(1, 1), part(3, 100))).when(size % 3 == 1, n).otherwise(F.concat(part(1, 3), part(5, 1), part(4, 1), part(6, 100)))
    one = table(spark, sf_dir, "part").select(odd.alias("a")).distinct()
    pairs = one.join(one.withColumnRenamed("a", "b"), F.col("a") != F.col("b"))
    a, b = F.col("a"), F.col("b")
    df = pairs.select("a", "b", S.distance(a, b).cast("long").alias("edits"), S.edit_similarity(a, b).alias("edit"), S.edit_ratio(a, b).alias("ratio"), S.namespace_similarity(a, b).alias("space"))
    return df.select("a", "b", "edits", *six_digits("edit", "ratio"), "space")


@query(f"WITH x AS (SELECT doc_id AS key, toxic = 1 AS label, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 100) / 100 END AS score FROM labels), c AS (SELECT {COUNTS} FROM (SELECT label AS t, coalesce(score >= 0.5, false) AS h FROM x WHERE label IS NOT NULL)), d AS (SELECT *, {RATIOS} FROM c) SELECT {FULL} FROM d")
def evaluated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    truth = rows.select(F.col("doc_id").alias("key"), (F.col("toxic") == 1).alias("label"))
    said = rows.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 100 / 100).alias("score"))
    return api.evaluate(truth, said).select(*CELLS, *six_digits(*RATES))


TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower({x}), '[-_ .~@/:]+', ' ', 'g'), '([0-9]+)', ' \\1 ', 'g'), '\\s+'), lambda z: z <> '')"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS t FROM part), v AS (SELECT t AS b, unnest([replace(t, ' ', '-'), replace(t, ' ', ''), '@own/' || t, split_part(t, ' ', 2) || '-' || split_part(t, ' ', 1), replace(t, 'l', '1'), t[1:2] || t[4] || t[3] || t[5:], t || 'x', t || '-utils', 'py' || t, split_part(t, ' ', 2), t, reverse(t)]) AS a FROM n),
p AS (SELECT DISTINCT a, b FROM v), w AS (SELECT a, b, lower(a) AS c, lower(b) AS d, {TOKENS.format(x='a')} AS x, {TOKENS.format(x='b')} AS y FROM p)
SELECT a, b, CASE WHEN c = d THEN NULL WHEN regexp_replace(c, '[-_ .~@/:]+', '', 'g') = regexp_replace(d, '[-_ .~@/:]+', '', 'g') THEN 'delimiters' WHEN regexp_replace(c, '^@[^/]*/', '') = regexp_replace(d, '^@[^/]*/', '') THEN 'scope'
WHEN len(x) > 1 AND list_sort(x) = list_sort(y) THEN 'order' WHEN {LOOKALIKE.replace("a LIKE", "c LIKE").replace("b LIKE", "d LIKE").replace("replace(a,", "replace(c,").replace("replace(b,", "replace(d,").replace("= b)", "= d)").replace("= a)", "= c)")} THEN 'lookalike'
WHEN damerau_levenshtein(c, d) = 1 THEN 'typo' WHEN starts_with(c, d) OR ends_with(c, d) THEN 'addition' WHEN len(x) > 0 AND len(list_filter(x, lambda z: NOT list_contains(y, z))) = 0 AND len(x) < len(y) THEN 'omission' END AS class FROM w""")
def attack_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done to part names to make others."""
    t, word = F.col("b"), lambda i: F.split_part("b", F.lit(" "), F.lit(i))
    part = lambda i, n: F.substring(t, i, n)
    made = [F.replace(t, F.lit(" "), F.lit("-")), F.replace(t, F.lit(" "), F.lit("")), F.concat(F.lit("@own/"), t), F.concat(word(2), F.lit("-"), word(1)), F.replace(t, F.lit("l"), F.lit("1")), F.concat(part(1, 2), part(4, 1), part(3, 1), part(5, 100)), F.concat(t, F.lit("x")), F.concat(t, F.lit("-utils")), F.concat(F.lit("py"), t), word(2), t, F.reverse(t)]
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("b")).distinct().withColumn("a", F.explode(F.array(*made))).distinct()
    return pairs.select("a", "b", attack_class(F.col("a"), F.col("b"), sounds=False).alias("class"))


# learned weights, detection, streams


@query()
def learned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("long"), F.col("text").contains("!!").alias("loud"), F.col("text").contains("|").alias("table"), (F.col("lang") == "en").alias("english"))
    df = d.join(table(spark, sf_dir, "labels"), "doc_id")
    flags = ["long", "loud", "table", "english"]
    return learned.importances(learned.fit(df, flags, "quality"), df, flags)


def length_judge(pairs):
    """A stand-in for a judge: a name of its target's length is adversarial."""
    same = pairs["query"].str.len() == pairs["package_name"].str.len()
    return B.no_judge(pairs).assign(is_adversarial_name=same.to_numpy())


@query()
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    top = P.popular(rows, "npm", top=20)
    doc = F.to_json(F.struct(F.col("package_name").alias("name"), F.lit("text").alias("description")))
    return D.detect(rows.join(top.select("package_name"), "package_name", "left_anti"), top, rows.select(F.col("package_name").alias("name"), doc.alias("doc")), "pypi", "2025-01-01", length_judge)


@query(f"""WITH {PARTS} SELECT p_partkey AS id, lower(l.package_name) AS target, levenshtein(lower(p_name), lower(l.package_name)) AS edits FROM part JOIN listed l ON lower(p_name) <> lower(l.package_name)
WHERE levenshtein(lower(p_name), lower(l.package_name)) < 3 AND levenshtein(lower(p_name), lower(l.package_name)) < 2 * length(p_name) // 3""")
def arrivals_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("package_name"))
    return arrivals.confusable(new, listed(spark, sf_dir)).select("id", "target", F.col("edits").cast("long").alias("edits"))


# what is left of the sources and joins


@query("SELECT DISTINCT p_name AS package_name FROM part WHERE p_name IS NOT NULL")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.catalog_names(table(spark, sf_dir, "part").withColumnRenamed("p_name", "package_name"))


@query("SELECT p_type || ':' || p_name AS package_name, 'maven' AS \"Ecosystem\" FROM part UNION ALL SELECT c_name, 'npm' FROM customer UNION ALL SELECT s_name, 'hf' FROM supplier")
def concatenated_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maven = table(spark, sf_dir, "part").select(F.col("p_type").alias("group_id"), F.col("p_name").alias("artifact_id"))
    npm = table(spark, sf_dir, "customer").select(F.col("c_name").alias("package_name"))
    return readers.dumps({"maven": maven, "npm": npm, "hf": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("context_id"))})


@query("SELECT DISTINCT p_name AS package_name FROM part WHERE length(p_name) < 10 ORDER BY 1 LIMIT 1000")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.short_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("package_name")).distinct())


@query("SELECT p_partkey, p_brand, p_type, coalesce(n, 0) AS n, n IS NOT NULL AS known FROM part LEFT JOIN (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1, 2) USING (p_brand, p_type)")
def results_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    truth = part.filter("p_size > 48").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return E.with_truth(part.select("p_partkey", "p_brand", "p_type"), truth, ["p_brand", "p_type"]).withColumn("known", F.col("n").isNotNull()).withColumn("n", F.coalesce("n", F.lit(0)))


@query("""WITH g AS (SELECT p_type || ':' || p_name || ':' || p_brand AS k, min(p_partkey) AS n FROM part GROUP BY 1), t AS (SELECT DISTINCT p_type || ':' || p_name || ':' || p_brand AS k FROM part WHERE p_size > 40)
SELECT g.k, coalesce(CASE WHEN t.k IS NOT NULL THEN 'active' END, CASE WHEN n % 3 = 0 THEN 'stealthy' ELSE 'benign' END) AS category FROM g LEFT JOIN t ON g.k = t.k""")
def grouped_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("k", E.truth_key(F.col("p_type"), F.col("p_name"), F.col("p_brand")))
    groups = part.groupBy("k").agg(F.min("p_partkey").alias("n")).withColumn("said", F.when(F.col("n") % 3 == 0, "a Stealthy one"))
    truth = part.filter("p_size > 40").select("k").distinct().withColumn("category", F.lit("active"))
    return E.with_category(groups, truth, "k", "category", "said").select("k", "category")


@query(f"""WITH {PAIRS}, l AS (SELECT unnest([2, 3, 4]) AS k), c AS (SELECT k, {COUNTS} FROM (SELECT k, split_part(a, ' ', 2) = split_part(b, ' ', 2) AS t, levenshtein(a, b) <= k AS h FROM pairs, l) GROUP BY k), d AS (SELECT *, {RATIOS} FROM c)
SELECT k AS "limit", {FULL}, round((coalesce(2 * p * r / nullif(p + r, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS mean_f1 FROM d""")
def edit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(2))
    df = name_pairs(spark, sf_dir).select((word(F.col("a")) == word(F.col("b"))).alias("t"), F.levenshtein("a", "b").alias("d"))
    return E.edit_classifier(df, "t", "d").select("limit", *CELLS, *six_digits(*RATES, "mean_f1"))


REGISTRIES = ("npm", "pypi", "maven", "nuget", "ruby", "golang", "hf")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, ['npm', 'pypi', 'maven', 'nuget', 'ruby', 'golang', 'hf'][doc_id % 7 + 1] AS r FROM documents),
f AS (SELECT *, CASE r WHEN 'npm' THEN 'Description:' || text || chr(10) || chr(10) || 'README:' || lang WHEN 'maven' THEN text
WHEN 'pypi' THEN CASE WHEN text = '' THEN lang ELSE lang || chr(10) || chr(10) || text END WHEN 'nuget' THEN CASE WHEN text = '' THEN lang ELSE lang || chr(10) || chr(10) || text END ELSE lang END AS raw FROM d)
SELECT doc_id, r AS registry, CASE WHEN doc_id % 3 <> 0 THEN 'doc-' || doc_id WHEN r = 'maven' THEN 'group-' || doc_id WHEN r = 'nuget' THEN NULL ELSE 'info-' || doc_id END AS name,
array_to_string(list_filter(string_split_regex(raw, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')[:100], ' ') AS description,
CASE r WHEN 'npm' THEN source || '|' || lang WHEN 'pypi' THEN source WHEN 'maven' THEN source || '|' || lang || '|own-' || lang WHEN 'nuget' THEN CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang ELSE source END ELSE CASE WHEN doc_id % 2 = 0 THEN 'l-' ELSE 'u-' END || source || '|own-' || lang END AS people FROM f""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of seven registries, every field in each document, of which a registry reads its own."""
    registry = F.element_at(F.array(*map(F.lit, REGISTRIES)), (F.col("doc_id") % 7 + 1).cast("int"))
    named = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    even = F.col("doc_id") % 2 == 0
    person = F.struct(F.col("source").alias("name"), F.when(even, F.concat(F.lit("l-"), "source")).alias("login"), F.concat(F.lit("u-"), "source").alias("uuid"))
    common = [
        F.when(F.col("doc_id") % 3 != 0, named("doc-")).alias("name"),
        F.struct(named("info-").alias("name"), F.col("lang").alias("summary"), F.col("text").alias("description")).alias("info"),
        F.struct(named("group-").alias("name"), F.col("text").alias("description"), F.array(person).alias("maintainers"), F.col("lang").alias("a")).alias("doc"),
        *(F.when(registry != "maven", F.col(c)).alias(n) for c, n in (("text", "description"), ("lang", "summary"), ("lang", "readme"))),
        F.struct(F.col("lang").alias("name")).alias("authors"),
        F.struct(F.concat(F.lit("own-"), "lang").alias("owner")).alias("repo_metadata"),
    ]
    people = lambda kind: F.to_json(F.struct(*common, kind.alias("maintainers"), F.array("source", "lang").alias("owners")))
    one_owner = F.to_json(F.struct(*common, F.col("source").alias("owners")))
    made = F.when(registry == "pypi", people(F.array("source"))).when((registry == "nuget") & ~even, one_owner).otherwise(people(F.array(person)))
    df = table(spark, sf_dir, "documents").select("doc_id", registry.alias("registry"), made.alias("doc"))
    doc, registry = F.col("doc"), F.col("registry")
    return df.select("doc_id", "registry", N.document_name(doc, registry).alias("name"), N.description(doc, registry).alias("description"), F.array_join(N.maintainers(doc, registry), "|").alias("people"))


INDEXED = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(q.e, p.e), 12) AS s FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)
SELECT query_id, place AS rank, id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM x) WHERE place <= 5"""


def indexed(spark: SparkSession, sf_dir: str, probes: int | None) -> DataFrame:
    """The five nearest of every fiftieth vector, by an index written for it."""
    e = table(spark, sf_dir, "embeddings")
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/vector-index-{uuid.uuid4().hex}"
    vector_index.build(e, path, "vec_id", "embedding")
    found = vector_index.Index(spark, path).search(e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, probes)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", *six_digits("similarity"))


@query(INDEXED)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir, None)


@query()
def vector_index_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of half the lists that the table has at most, as its vectors lie nearly alike in all directions; recall is measured in the tests."""
    n = table(spark, sf_dir, "embeddings").count()
    return indexed(spark, sf_dir, max(1, math.isqrt(n) * 6 // 10))


@query()
def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.halved(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def flagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("long"), F.col("text").contains("!!").alias("loud"), F.col("text").contains("|").alias("table"), (F.col("lang") == "en").alias("english"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


@query()
def learned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, flags = flagged_documents(spark, sf_dir), ["long", "loud", "table", "english"]
    flags_as_numbers = df.select(*(F.col(c).cast("double").alias(c) for c in flags), "quality")
    return learned.scored(learned.fit(flags_as_numbers, flags, "quality"), flags_as_numbers, flags, "quality")


@query()
def learned_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.validated(flagged_documents(spark, sf_dir), ["long", "loud", "table", "english"], "quality", "doc_id")
