"""Benchmark decontamination by an FM-index of words for each shard of the documents.

Documents are packed into shards of about ``SHARD`` words, a separator behind
each; longer ones are cut into overlapping pieces. A shard's index holds its
vocabulary, the Burrows-Wheeler transform of its words as a wavelet matrix, and
the positions of some suffixes: each document's first word and every ``RATE``-th
after it. A phrase is searched backward, word by word, through ranks in the
matrix, which leaves the range of the suffixes that begin with it; a suffix of
the range is located by stepping back to the nearest one whose position is
kept. Where phrases occur, their words are merged into spans to remove.

Shards are made inside the tasks that read the documents, so texts aren't
shuffled, and kept as a table in the checkpoint folder. Phrases are searched
block by block; a block has about ``PHRASES`` of them, however many there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewarden.llm.common import BATCH_BYTES, cut, trim

#: Words of a phrase; words of a shard and of a piece of a document; places between kept positions; phrases of a block; places located at once.
WINDOW, SHARD, PIECE, RATE, PHRASES, PLACES = 10, 1 << 20, 1 << 19, 16, 200_000, 1 << 20
#: Bytes of a text that are cut into words at once.
CHUNK = 8_000_000
#: Bits of a position in a sort key: a shard has fewer than 2^21 words and separators.
AT = np.uint64(21)
PLACE = np.uint64((1 << 21) - 1)

#: Letters A-Z lowered, and every ASCII byte that isn't a digit or letter made a space.
_LOWERED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII of a text in UTF-8, A-Z lowered."""
    return text.translate(_LOWERED).split()


def pieces(text: bytes, piece: int, overlap: int, chunk: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first word's number, words) of stretches of a text of at most ``piece`` words, which share ``overlap``; one of no words for a text without.

    Words are made chunk by chunk of a long text, so that few are held at once.
    """
    low, at, start, held = text.translate(_LOWERED), 0, 0, []
    while at < len(low):
        end = low.find(b" ", at + chunk)
        end = len(low) if end < 0 else end
        held += low[at:end].split()
        at = end
        while len(held) > piece:
            yield start, held[:piece]
            start, held = start + piece - overlap, held[piece - overlap :]
    yield start, held


class Vocabulary(dict):
    """Numbers of words by first use, from 1; 0 is the separator."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The positions of a text in the order of what follows up to the next 0, ties by position.

    The text ends with a 0. Prefixes are doubled, and only positions still tied
    are sorted again; a key and its position are one number, so each round
    sorts plain numbers.
    """
    n = len(text)
    bits = int(text.max(initial=1)).bit_length()
    h = max(1, min(4, (64 - int(AT)) // bits))
    key, stopped = text.astype(np.uint64), text == 0
    for j in range(1, h):
        after = np.where(stopped, 0, np.concatenate([text[j:], np.zeros(min(j, n), text.dtype)])[:n])
        stopped |= after == 0
        key = key << np.uint64(bits) | after.astype(np.uint64)
    packed = key << AT | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & PLACE).astype(np.int64)
    key = packed >> AT
    row = np.arange(n)
    starts = np.concatenate([[True], key[1:] != key[:-1]]) | (key & np.uint64((1 << bits) - 1) == 0)  # those that reached a separator are told apart by position
    rank = np.empty(n, np.uint64)
    first = np.maximum.accumulate(np.where(starts, row, 0))
    rank[order] = first
    while True:
        alone = starts & np.concatenate([starts[1:], [True]])
        row, first = row[~alone], first[~alone]
        if not len(row):
            return order
        at = order[row]
        packed = first.astype(np.uint64) << (AT + AT) | rank[at + h] << AT | at.astype(np.uint64)
        packed.sort()
        at = (packed & PLACE).astype(np.int64)
        order[row] = at
        key = packed >> AT
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(starts, row, 0))
        rank[at] = first
        h *= 2


class Bits:
    """A row of bits with ranks."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Bits in words of 64, one more than they fill."""
        out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        out[: len(some)] = some
        return out.view("<u8")

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.packed[word] & below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class Index:
    """The FM-index of a text of symbols whose documents each end with a 0."""

    def __init__(self, levels: list[np.ndarray], zeros: list[int], counts: np.ndarray, marked: np.ndarray, positions: np.ndarray) -> None:
        self.levels, self.zeros = list(map(Bits, levels)), zeros
        self.marked, self.positions = Bits(marked), positions
        self.start = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        # where each symbol's run begins below the last level
        self.floor = self.down(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    @classmethod
    def parts(cls, text: np.ndarray, rate: int = RATE) -> dict:
        """What an index is made of."""
        order = suffix_order(text)
        n, size = len(text), int(text.max(initial=0)) + 1
        symbols = text[order - 1]  # what is before position 0 is the last separator
        levels, zeros = [], []
        for level in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            levels.append(Bits.pack(bits))
            zeros.append(n - int(np.count_nonzero(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        begins = np.flatnonzero(np.concatenate([[True], text[:-1] == 0]))
        place = np.arange(n) - np.repeat(begins, np.diff([*begins, n]))
        marked = (place % rate == 0)[order]
        return {"levels": levels, "zeros": zeros, "counts": np.bincount(text, minlength=size), "marked": Bits.pack(marked), "positions": order[marked].astype(np.int32)}

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Places carried through all levels by the bits of their symbols."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where(symbol >> (len(self.levels) - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The first row at or after i's that begins with the symbol, one word earlier."""
        return self.start[symbol] + self.down(symbol, i) - self.floor[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of those that occur; phrases end at the last column, with -1 before shorter ones."""
        which = np.flatnonzero((phrases[:, -1] > 0) & (phrases != 0).all(axis=1))
        low, high = self.start[phrases[which, -1]], self.start[phrases[which, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[which, j]
            more = np.flatnonzero(symbol > 0)
            both = self.back(np.tile(symbol[more], 2), np.concatenate([low[more], high[more]]))
            low[more], high[more] = both[: len(more)], both[len(more) :]
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes of the order."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            kept = self.marked.at(rows)
            out[left[kept]] = self.positions[self.marked.rank(rows[kept])] + steps
            left, rows, steps = left[~kept], rows[~kept], steps + 1
            i, symbol = rows, np.zeros(len(rows), np.int64)
            for bits, zeros in zip(self.levels, self.zeros):
                one, ones = bits.at(i), bits.rank(i)
                symbol = symbol << 1 | one
                i = np.where(one, zeros + ones, i - ones)
            rows = self.start[symbol] + i - self.floor[symbol]
        return out


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, piece: int = PIECE, overlap: int = WINDOW - 1, rate: int = RATE) -> DataFrame:
    """(doc, id, n_words, data): a row for each document, numbered, and a row with data for each shard's index.

    Every row of ``docs`` is a document; null texts have no words. A document of
    over ``piece`` words is indexed in pieces that share ``overlap`` words.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spec = T.StructType([T.StructField("doc", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spec)
        number = TaskContext.get().partitionId() << 33
        vocabulary, parts, places, total = Vocabulary(), [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal vocabulary, parts, places, total
            made = Index.parts(np.concatenate(parts), rate)
            data = pickle.dumps({"words": list(vocabulary), "places": np.array(places, np.int64), **made}, protocol=5)
            vocabulary, parts, places, total = Vocabulary(), [], [], 0
            return pa.RecordBatch.from_pydict({"doc": [None], "id": [None], "n_words": [None], "data": [data]}, schema=out)

        for batch in batches:
            numbers, sizes = [], []
            for text in batch.column(1).to_pylist():
                numbers.append(number)
                size = 0
                for a, some in pieces(text or b"", piece, overlap):
                    size = a + len(some)
                    if not some:
                        continue
                    coded = np.zeros(len(some) + 1, np.int32)
                    coded[:-1] = np.fromiter(map(vocabulary.__getitem__, some), np.int32, len(some))
                    places.append((total, number, a))
                    parts.append(coded)
                    total += len(coded)
                    if total >= shard:
                        yield closed()
                sizes.append(size)
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(0).cast(out.field("id").type), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.binary())], schema=out)
        if total:
            yield closed()
        trim()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, spec)


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, phrase): the distinct runs of ``window`` words of each item, or all words of a shorter one, joined by spaces."""

    def run(frames):
        for f in frames:
            for item, text in zip(f["item"], f["text"]):
                w = words(bytes(text or b""))
                seen = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
                made = [(item, p.decode("utf-8", "replace")) for p in seen]
                for a in range(0, len(made), 100_000):
                    yield pd.DataFrame(made[a : a + 100_000], columns=["item", "phrase"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInPandas(run, "item string, phrase string").distinct()


class Block:
    """Phrases to search for: their distinct words, a row of word numbers for each, and the items that each one is of."""

    def __init__(self, rows: pd.DataFrame, window: int) -> None:
        known, numbers = rows["phrase"].unique(), Vocabulary()
        self.phrases = np.full((len(known), window), -1, np.int64)
        for i, p in enumerate(known):
            w = p.encode().split(b" ")
            self.phrases[i, window - len(w) :] = [numbers[x] for x in w]
        self.words = list(numbers)
        self.lengths = (self.phrases >= 0).sum(axis=1)
        place = dict(zip(known, range(len(known))))
        named = rows[rows["item"].notna()]
        self.names, item = np.unique(named["item"].to_numpy(str), return_inverse=True) if len(named) else (np.zeros(0, str), np.zeros(0, np.int64))
        of = np.array([place[p] for p in named["phrase"]], np.int64)
        by = np.argsort(of, kind="stable")
        self.items = item[by]
        self.first = np.searchsorted(of[by], np.arange(len(known) + 1))

    def within(self, data: bytes) -> tuple[np.ndarray, ...]:
        """(doc, start, end) of merged spans of words, and (doc, item) pairs, of a shard."""
        shard = pickle.loads(data)
        index = Index(shard["levels"], shard["zeros"], shard["counts"], shard["marked"], shard["positions"])
        number = dict(zip(shard["words"], range(1, len(shard["words"]) + 1)))
        symbol = np.array([-1, *(number.get(w, 0) for w in self.words)], np.int64)
        which, low, high = index.search(np.where(self.phrases < 0, -1, symbol[np.maximum(self.phrases, 0)]))
        places, spans, pairs = shard["places"], [], []
        ends = np.cumsum(high - low)
        for a in range(0, int(ends[-1]) if len(ends) else 0, PLACES):
            at = np.arange(a, min(a + PLACES, int(ends[-1])))
            of = np.searchsorted(ends, at, side="right")
            found = index.locate(low[of] + at - (ends[of] - (high - low)[of]))
            piece = np.searchsorted(places[:, 0], found, side="right") - 1
            doc, start = places[piece, 1], found - places[piece, 0] + places[piece, 2]
            spans.append(merged(doc, start, start + self.lengths[which[of]]))
            pairs.append(np.unique(np.stack([doc, which[of]], axis=1), axis=0))
        if not spans:
            return (np.zeros(0, np.int64),) * 5
        doc, start, end = merged(*map(np.concatenate, zip(*spans)))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        sizes = self.first[pairs[:, 1] + 1] - self.first[pairs[:, 1]]
        item = self.items[np.repeat(self.first[pairs[:, 1]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        named = np.unique(np.stack([np.repeat(pairs[:, 0], sizes), item], axis=1), axis=0)
        return doc, start, end, named[:, 0], named[:, 1]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents that overlap or touch, as one."""
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    if not len(doc):
        return doc, start, end
    turn = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    span = int(end.max()) + 2  # documents laid apart, so that one running maximum serves all
    reach = np.maximum.accumulate(turn * span + end)
    new = np.concatenate([[True], (turn * span + start)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], start[new], reach[last] - turn[last] * span


def find(index: DataFrame, block: Block) -> DataFrame:
    """(doc, spans, items) of the documents in which phrases of a block occur, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spec)
        for batch in batches:
            for data in batch.column(0):
                doc, start, end, of, item = block.within(data.as_py())
                docs, first = np.unique(doc, return_index=True)
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
                lists = [pa.ListArray.from_arrays(pa.array([*at, len(values)], pa.int32()), values) for at, values in ((first, spans), (np.searchsorted(of, docs), pa.array(block.names[item].tolist(), pa.string())))]
                yield pa.RecordBatch.from_arrays([pa.array(docs), *(a.cast(f.type) for a, f in zip(lists, list(out)[1:]))], schema=out)
        trim()

    spec = T._parse_datatype_string("doc long, spans array<struct<start:long,end:long>>, items array<string>")
    return index.filter("data is not null").select("data").mapInArrow(run, spec)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD, piece: int = PIECE, block: int = PHRASES) -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every row: words inside any occurrence of a phrase, merged spans of these, the items' ids sorted as strings.

    A phrase is a run of ``window`` words of an item, or all words of one that
    has fewer; an item without words has none. Null and empty texts have no
    words and no spans. Rows that repeat an id are looked at one by one; rows of
    ``items`` that do are one item; a null item id hits words but isn't listed.
    Other columns are left out; an empty table gives no rows, no items no hits.
    """
    index = cut(shards(docs, id_col, text_col, shard, piece, window - 1))
    wanted = phrases(items, item_col, item_text, window)
    blocks = max(1, -(-wanted.count() // block))
    wanted = cut(wanted.withColumn("block", F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks))))
    hits = None
    for b in range(blocks):
        one = cut(find(index, Block(wanted.filter(F.col("block") == b).select("item", "phrase").toPandas(), window)))
        hits = one if hits is None else hits.unionByName(one)
    whole = hits.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    one_by_one = lambda s: F.aggregate(
        F.array_sort(s),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    none = lambda kind: F.array().cast(kind)
    df = index.filter("doc is not null").select("doc", F.col("id").alias(id_col), "n_words").join(whole, "doc", "left")
    df = df.withColumn("spans", F.coalesce(one_by_one(F.col("spans")), none("array<struct<start:bigint,end:bigint>>")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return df.select(id_col, "n_words", hit.alias("n_hit"), "spans", F.coalesce(F.array_sort(F.array_distinct("items")), none("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row, see ``contaminated``."""
    found = contaminated(docs, items, **options)
    own = found.columns[0]
    return found.select(own, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


_SPLIT = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: DuckDB SQL of ``decontaminate`` with its defaults, without spans.
ORACLE = f"""WITH w AS (SELECT doc_id, row_number() OVER () AS u, {_SPLIT} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_SPLIT} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) r(i) WHERE len(w) > 0),
g AS (SELECT u, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT u, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT DISTINCT n FROM p) WHERE i + n - 1 <= len(w)),
h AS (SELECT u, i, g.n, item FROM g JOIN p ON p.p = g.p AND p.n = g.n),
c AS (SELECT u, count(DISTINCT i + j) AS hit FROM (SELECT DISTINCT u, i, n FROM h), unnest(range(0, n)) r(j) GROUP BY 1),
t AS (SELECT u, count(DISTINCT item) AS n, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated FROM w LEFT JOIN c ON c.u = w.u LEFT JOIN t ON t.u = w.u"""
