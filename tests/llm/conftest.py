import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids string, size string, score double, target string, rank string, shard string, words string, component_id string, kept string, cell string, taken string, source_size string, declared string, bucket string, `a.b` string, m map<string,int>"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def item_rows(rows):
    """Items with passages of the rows' texts, short, empty, null and repeated ones, and one of a null id."""
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, part(texts[0], 29_980, 30_000)), (10, part(texts[1], 3, 25).upper()), (2, "one"), (3, None), (4, ""), (5, "nothing of this is anywhere at all in these texts, is it"), (5, part(texts[1], 10, 30)), (6, "x x x"), (7, " \t"), (None, part(texts[3], 0, 15)), (8, "naïve space"), (9, "don't")]
    return [(i, t, 0, 1) for i, t in items]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeats, copies, odd characters; and columns named as the operators' own."""
    rng = random.Random(1)
    body = words(rng, 120)
    texts = [
        (1, ""), (2, None), (3, "one"), (4, words(rng, 30000)), (5, body), (5, body), (6, body + " x"), (7, body.upper()), (8, " \t\n "), (9, "x " * 500),
        (None, words(rng, 40)), (10, "Ünï çödé 中文 😀 naïve space em  two  \n\n lines"), (11, "a" * 5000), (12, words(rng, 4)), (13, words(rng, 5)), (14, "don't we'll  'tis  <|endoftext|> 12345"), (15, body),
    ]
    more = [(100 + i, words(rng, rng.randint(0, 80))) for i in range(60)]
    rest = ("fp", "ids", "7", None, "t", "r", "s", "w", "c", "k", "l", "n", "z", "d", "b", "dot", {"x": 1})
    langs, sources = ["en", None, "de"], ["s1", None, "s2", "a.example.org", "s1"]
    return [(i, t, langs[n % 3], sources[n % 5], None if t is None else len(t), *rest) for n, (i, t) in enumerate(texts + more)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, edge, edge_rows, tmp_path_factory):
    """The edge rows as a documents table, with few labels and vectors."""
    d = str(tmp_path_factory.mktemp("edge"))
    edge.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(0, "http://a.example.org/x", "<html lang=en><p>the house</p></html>"), (1, None, None), (2, "http://[bad", "<HTML class='x' lang='de-AT'>")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(item_rows(edge_rows), "item_id long, text string, doc_id long, n int").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, nothing, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    nothing.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d
