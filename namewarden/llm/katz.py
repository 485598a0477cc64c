"""Katz backoff language model of any order: Good-Turing discounts, exactly normalised backoff weights.

P(w | u..v) = d(c(u..vw)) c(u..vw) / c(u..v) for a seen n-gram, else
alpha(u..v) P(w | ..v), one word of context less, down to P(w) = d(c(w)) c(w) / N
for a seen word and what the discounts leave for the one class of unknown
words. alpha(u..v) = (what is left of u..v) / (1 - sum of P(w | ..v) over the w
seen after u..v). A context all of whose next words are counted over ``CUTOFF``
times leaves nothing; it is given one more occurrence, and that is left. A
text's boundary is one symbol: its end is a token, and it fills the contexts
before the first words.

Documents are packed into blocks: a local vocabulary of word hashes, of 64 bits,
and local token numbers. The first order's table numbers the words, and from
then on they go by these. Order by order each block asks the table of n-grams,
partitioned by context, for its distinct n-grams' counts and for the sums of
those contexts that it must back off from. A request carries the block's own
training counts and the lower order's counts, so a part of the table is made and
answered in one go, and no part is asked for a block that has nothing in it:
rows are at most as many as distinct n-grams of blocks. What is shuffled is
packed. A context that holds over 1 / HOT of all tokens (so fewer than HOT there
are) is spread over the parts by the next word, and its sums are added up.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewarden.llm.common import cut, trim

#: Words of an n-gram; bytes of text of a block; n-grams of a part; counts up to CUTOFF are discounted; HOT: see above.
ORDER, BLOCK_BYTES, PART_KEYS, CUTOFF, HOT = 3, 8_000_000, 1_000_000, 5, 1000
#: Documents whose crc32(id as text) mod FOLDS is 0 are held out.
FOLDS = 10
#: Of the base score.
ADDED = 0.1

#: Level 0: a block itself; else the answers of an order.
ROWS = "block long, level int, part int, data binary"
#: For a block -1: sums of a hot context, or of all (a null hot).
SUMS = ROWS + ", hot long, sums array<double>"


def pack(**arrays) -> bytes:
    """Arrays as bytes: the planes of their bytes apart, compressed."""
    import zstandard

    out = {}
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.ndim == 1 and len(a) and a.dtype == np.int64:
            a = a.astype(np.min_scalar_type(int(a.max())) if a.min() >= 0 else np.int64)
        out[k] = (a.dtype.str, a.shape, a.reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(out))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    out = {}
    for k, (kind, shape, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items():
        kind = np.dtype(kind)
        out[k] = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(shape)
    return out


class Vocabulary(dict):
    """Words by first use; 0 is the boundary, as no word is empty."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """Whether crc32 of the id as text is 0 modulo ``folds``; a null id is a training one."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def discounts(n: np.ndarray, cutoff: int) -> np.ndarray:
    """Factors for counts 0..cutoff (0: unused) from numbers n[r] of things counted r times.

    Good-Turing, scaled so that what is left equals the things seen once; where
    the numbers don't allow it, half a count is taken off each.
    """
    out = np.ones(cutoff + 1)
    r = np.arange(1, cutoff + 1)
    if (n[1 : cutoff + 2] > 0).all():
        last = (cutoff + 1) * n[cutoff + 1] / n[1]
        found = ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last) if last < 1 else np.zeros(cutoff)
        if (found > 0).all() and (found < 1).all():
            out[1:] = found
            return out
    out[1:] = (r - 0.5) / r
    return out


class Unigrams:
    """The lowest order: probabilities by count, and of the unknown class (count 0)."""

    def __init__(self, n: np.ndarray, tokens: int, cutoff: int) -> None:
        self.tokens, self.cutoff = tokens, cutoff
        self.factor = discounts(n, cutoff)
        left = sum(float(n[r]) * r * (1 - self.factor[r]) for r in range(1, cutoff + 1)) / tokens if tokens else 1.0
        self.scale = 1.0
        if left <= 0:  # nothing is counted seldom: one token's worth for the unknown
            left = 1 / (tokens + 1)
            self.scale = 1 - left
        self.unknown = left

    def __call__(self, count: np.ndarray) -> np.ndarray:
        count = np.asarray(count, np.int64)
        p = self.factor[np.minimum(count, self.cutoff)] if self.cutoff else np.ones(len(count))
        p = np.where(count > self.cutoff, 1.0, p) * count / max(1, self.tokens) * self.scale
        return np.where(count > 0, p, self.unknown)


def _mix(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = (u ^ (v * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """A row per block of documents, and the numbers of its tokens, its training tokens and its training documents."""

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        seq, vocab, ids, lens, tokens, size = 0, None, [], [], [], 0

        def close():
            nonlocal seq, vocab, ids, lens, tokens, size
            flat = np.concatenate(tokens)
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))
            train = np.array([not held_out(i) for i in ids], bool)
            order = np.argsort(-np.bincount(flat, minlength=len(words))[1:], kind="stable") + 1  # frequent words get small numbers, but 0 stays the boundary
            order = np.concatenate([[0], order])
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order), dtype=np.int32)
            words, flat = words[order], number[flat]
            data = pack(ids=np.array([0 if i is None else i for i in ids], np.int64), null=np.array([i is None for i in ids], bool), lens=np.array(lens, np.int64), train=train, words=words, tokens=flat)
            made = pa.RecordBatch.from_pydict({"block": [TaskContext.get().partitionId() << 24 | seq], "level": [0], "part": [0], "data": [data], "tokens": [len(flat)], "trained": [int(np.array(lens)[train].sum())], "docs": [int(train.sum())]}, schema=pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("tokens", pa.int64()), ("trained", pa.int64()), ("docs", pa.int64())]))
            seq, vocab, ids, lens, tokens, size = seq + 1, None, [], [], [], 0
            return made

        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            for i in range(batch.num_rows):
                if vocab is None:
                    vocab = Vocabulary({b"": 0})
                raw = (texts[i].as_py() or "").encode("utf-8", "replace").lower()
                found = np.fromiter(map(vocab.__getitem__, raw.split()), np.int32)
                tokens += [found, np.zeros(1, np.int32)]
                ids.append(keys[i].as_py())
                lens.append(len(found) + 1)
                size += len(raw)
                if size >= block_bytes:
                    yield close()
        if ids:
            yield close()
        trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ROWS + ", tokens long, trained long, docs long")


def _histogram(counts: np.ndarray, cutoff: int) -> np.ndarray:
    """How many counts are 0, 1, .. cutoff + 1, and above."""
    return np.bincount(np.minimum(counts, cutoff + 2), minlength=cutoff + 3)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Block:
    """A block of documents and what is known of its n-grams, order by order.

    Per order: ``grams`` (each token's distinct n-gram), ``counts`` of these,
    and per token ``context`` (its hash), ``seen`` (how often it was trained on)
    and ``bare``; ``at`` and ``sums`` give a context's mass and counts of
    counts where a token has to back off from it.
    """

    def __init__(self, data: bytes, docs: int, hot_over: float) -> None:
        self.__dict__.update(unpack(data))
        self.hash = self.words[self.tokens]
        self.begin = np.cumsum([0, *self.lens[:-1]])
        self.place = np.arange(len(self.tokens)) - np.repeat(self.begin, self.lens)
        self.trained = np.repeat(self.train, self.lens)
        self.docs, self.hot_over, self.level = docs, hot_over, 0

    def before(self, values: np.ndarray, back: int, first) -> np.ndarray:
        """Each token's value of the token ``back`` places before it in its text; ``first`` where the text begins later."""
        out = np.concatenate([values[:back], values[:-back]]) if len(values) > back else np.resize(values, len(values))
        return np.where(self.place < back, first, out)

    def grow(self, parts: int) -> None:
        """Finds the distinct n-grams of the next order, sorted by part, context and next word."""
        self.level = k = self.level + 1
        n = len(self.words)
        if k == 1:
            self.context, self.seen = np.zeros(len(self.hash), np.uint64), np.full(len(self.hash), np.iinfo(np.int64).max)
            first, which = np.empty(n, np.int64), self.tokens
            first[self.tokens[::-1]] = np.arange(len(self.tokens) - 1, -1, -1)
        else:
            before = self.before(self.hash, k - 1, self.words[0])
            self.context = before if k == 2 else _mix(before, self.context)
            self.seen = self.before(self.counts[self.grams], 1, self.docs)
            code = self.before(self.grams, 1, len(self.counts)) * n + self.tokens
            _, first, which = np.unique(code, return_index=True, return_inverse=True)
        context = self.context[first]
        self.hot = self.seen > self.hot_over
        spread = np.where(self.hot[first], _mix(context, self.hash[first]), context * np.uint64(0x9E3779B97F4A7C15))
        part = (spread >> np.uint64(20)) % np.uint64(parts)
        # by part; a context's n-grams beside each other (any that come between only make a further run)
        order = np.argsort((part << np.uint64(44)) | (context & np.uint64((1 << 44) - 1)), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.first, self.grams, self.part = first[order], back[which.ravel()], part[order].astype(np.int64)
        # runs of one context in one part
        self.run = _runs(_mix(self.context[self.first], self.part.astype(np.uint64)))
        self.run_of = np.repeat(np.arange(len(self.run)), np.diff([*self.run, len(self.first)]))

    def requests(self, lower: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, bytes]]:
        """(part, request); ``lower``: each token's count in the order below, and what it is a part of there."""
        own = np.bincount(self.grams[self.trained], minlength=len(self.first))
        starts, out = _runs(self.part), []
        for a, b in zip(starts, [*starts[1:], len(self.part)]):
            run = self.run[slice(*np.searchsorted(self.run, (a, b)))]
            at = self.first[run]
            next_word = self.hash[self.first[a:b]]
            next_word = next_word if self.level == 1 else next_word.astype(np.int64)  # numbers are packed small
            steps = np.diff(self.context[at], prepend=np.uint64(0))
            out.append((int(self.part[a]), pack(steps=steps, run=np.diff([*run, b]), next=next_word, own=own[a:b], count=lower[0][self.first[a:b]], of=lower[1][at], hot=self.hot[at])))
        return out

    def answered(self, answers: list[bytes], hot: dict[int, tuple[float, np.ndarray]]) -> None:
        """Takes the answers of this order's parts, and the sums of hot contexts."""
        got = [unpack(d) for d in answers]
        self.counts = np.concatenate([a["counts"] for a in got]).astype(np.int64)
        if self.level == 1:  # from here on words go by their numbers
            self.words = self.words.copy()
            self.words[self.tokens[self.first]] = np.concatenate([a["numbers"] for a in got]).astype(np.uint64)
            self.hash = self.words[self.tokens]
        bare = np.concatenate([a["bare"] for a in got]).astype(bool)
        at = np.concatenate([a["at"] + n for a, n in zip(got, np.cumsum([0, *(len(a["bare"]) for a in got)]))])
        mass, few = (np.concatenate([a[c] for a in got]) for c in ("mass", "few"))
        sums = np.zeros((len(self.run), 1 + few.shape[1]))
        sums[at.astype(np.int64)] = np.column_stack([mass, few])
        context = self.context[self.first[self.run]].view(np.int64)
        for i in np.flatnonzero(self.hot[self.first[self.run]]).tolist():
            sums[i, 0], sums[i, 1:] = hot[int(context[i])]
            bare[i] = not sums[i, 1:].any()
        self.sums, self.bare = sums, bare[self.run_of][self.grams]

    def probability(self, lower: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Each token's probability in this order, given that of the order below."""
        cutoff = len(factor) - 1
        count = self.counts[self.grams]
        seen = np.maximum(self.seen, 1)
        found = np.where(count > cutoff, 1.0, factor[np.minimum(count, cutoff)]) * count / (seen + self.bare)
        sums = self.sums[self.run_of][self.grams]
        left = np.where(self.bare, 1 / (seen + 1), (sums[:, 1:] @ (np.arange(1, cutoff + 1) * (1 - factor[1:]))) / seen)
        back = np.where(self.seen > 0, left / np.maximum(1 - sums[:, 0], 1e-300), 1.0) * lower
        return np.where((count > 0) & (self.seen > 0), found, back)


class Model:
    """What the orders done so far are known by: parts, discount factors, hot contexts' sums, the lowest order and totals."""

    def __init__(self, docs: int, tokens: int, cutoff: int) -> None:
        self.docs, self.tokens, self.cutoff, self.hot_over = docs, tokens, cutoff, tokens / HOT
        self.parts: list[int] = []
        self.factors: list[np.ndarray] = []
        self.hot: list[dict] = []
        self.unigrams: Unigrams | None = None
        self.words = 0

    def replay(self, f: pd.DataFrame) -> tuple[Block, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """A block with all answers so far, its tokens' probabilities, and its tokens' counts in the last order with what these are a part of."""
        trim()
        block = Block(f.data[f.level == 0].iloc[0], self.docs, self.hot_over)
        p, lower = np.zeros(len(block.tokens)), (np.zeros(len(block.tokens), np.int64), np.zeros(len(block.tokens), np.int64))
        for k, parts in enumerate(self.parts):
            block.grow(parts)
            block.answered(f[f.level == k + 1].sort_values("part").data.to_list(), self.hot[k])
            count = block.counts[block.grams]
            if k == 0:
                p, lower, block.unigram = self.unigrams(count), (count, np.zeros(len(count), np.int64)), count
            else:
                p, lower = block.probability(p, self.factors[k]), (count, block.seen + block.bare)
        return block, p, lower

    def learn(self, histogram: np.ndarray, hot: dict, parts: int) -> None:
        """Adds an order."""
        if self.unigrams is None:
            self.unigrams, self.words = Unigrams(histogram, self.tokens, self.cutoff), int(histogram[1:].sum())
        self.parts.append(parts)
        self.factors.append(discounts(histogram, self.cutoff))
        self.hot.append(hot)

    def below(self, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The last order's probabilities of trained n-grams, by their counts and what these are a part of."""
        if len(self.parts) == 1:
            return self.unigrams(count)
        factor = self.factors[-1]
        return np.where(count > self.cutoff, 1.0, factor[np.minimum(count, self.cutoff)]) * count / np.maximum(of, 1)


def _requests(grouped, model: Model, parts: int) -> DataFrame:
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        block, _, lower = model.replay(f)
        block.grow(parts)
        return pd.DataFrame([(key[0], block.level, p, data) for p, data in block.requests(lower)], columns=["block", "level", "part", "data"])

    return grouped.applyInPandas(run, ROWS)


def _table(requests: DataFrame, model: Model, parts: int) -> DataFrame:
    """For each part and block the answers to a request, and rows of sums."""
    cutoff, lowest = model.cutoff, not model.parts

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        trim()
        asked = [unpack(d) for d in f.data]
        contexts, of = np.unique(np.concatenate([np.cumsum(a["steps"]) for a in asked]), return_inverse=True)
        run_of = np.concatenate([a["run"] for a in asked]).astype(np.int64)
        of_gram = np.repeat(of, run_of)
        word = np.concatenate([a["next"].astype(np.uint64) for a in asked])
        _, first, at = np.unique(_mix(contexts[of_gram], word), return_index=True, return_inverse=True)
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, at, np.concatenate([a["own"] for a in asked]).astype(np.int64))
        owner = of_gram[first]
        n = len(contexts)
        mass = np.zeros(n)
        if not lowest:
            below = np.repeat(np.concatenate([a["of"] for a in asked]).astype(np.int64), run_of)[first]
            p = model.below(np.concatenate([a["count"] for a in asked]).astype(np.int64)[first], below)
            mass = np.bincount(owner, np.where(counts > 0, p, 0.0), minlength=n)
        few = np.stack([np.bincount(owner[counts == r], minlength=n) for r in range(1, cutoff + 1)], axis=1)
        bare = ~few.any(axis=1)
        ends, runs = np.cumsum([0, *(int(a["run"].sum()) for a in asked)]), np.cumsum([0, *(len(a["run"]) for a in asked)])
        number = None
        if lowest:  # words are numbered, frequent ones first, apart from those of other parts
            number = np.empty(len(counts), np.int64)
            number[np.argsort(-counts, kind="stable")] = np.arange(len(counts)) * parts + int(key[0])
        rows: list[tuple] = []
        for i, block in enumerate(f.block):
            mine, got = of[runs[i] : runs[i + 1]], counts[at[ends[i] : ends[i + 1]]]
            lengths = asked[i]["run"].astype(np.int64)
            unseen = np.flatnonzero(np.bincount(np.repeat(np.arange(len(mine)), lengths), got == 0, minlength=len(mine)) > 0)
            names = {"numbers": number[at[ends[i] : ends[i + 1]]]} if lowest else {}
            rows.append((block, int(f.level.iloc[0]), key[0], pack(**names, counts=got, bare=bare[mine], at=unseen, mass=mass[mine[unseen]], few=few[mine[unseen]].astype(np.int32)), None, None))
        hot = np.zeros(n, bool)
        hot[of] = np.concatenate([a["hot"] for a in asked])
        rows.append((-1, 0, key[0], None, None, _histogram(counts, cutoff).astype(float).tolist()))
        rows += [(-1, 0, key[0], None, int(contexts[i].view(np.int64)), [float(mass[i]), *few[i].astype(float).tolist()]) for i in np.flatnonzero(hot)]
        columns = dict(zip(("block", "level", "part", "data", "hot", "sums"), zip(*rows)))
        return pd.DataFrame(columns | {"hot": pd.array(columns["hot"], "Int64")})  # never through floats

    return requests.groupBy("part").applyInPandas(run, SUMS)


def _sums(table: DataFrame) -> tuple[np.ndarray, dict[int, tuple[float, np.ndarray]]]:
    """The histogram of counts, and hot contexts' mass and counts of counts: a few numbers for each of fewer than ``HOT`` contexts."""
    cells = table.filter("block < 0").select("hot", F.posexplode("sums").alias("i", "x")).groupBy("hot", "i").agg(F.sum("x").alias("x")).collect()
    found: dict = {}
    for r in cells:
        found.setdefault(r.hot, {})[r.i] = r.x
    line = lambda d: np.array([d[i] for i in range(len(d))])
    histogram = line(found.pop(None, {})).astype(np.int64)
    return histogram, {h: (d[0], line(d)[1:]) for h, d in found.items()}


def _gather(blocks: DataFrame, tables: list[DataFrame]):
    """The blocks' rows beside their answers, grouped by block."""
    every = blocks.select("block", "level", "part", "data")
    for t in tables:
        every = every.unionByName(t.filter(F.col("block") >= 0).select("block", "level", "part", "data"))
    return every.groupBy("block")


def _scores(grouped, model: Model, id_col: str) -> DataFrame:
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        b, p, _ = model.replay(f)
        base = np.log10((b.unigram + ADDED) / (model.tokens + ADDED * (model.words + 1)))
        total = lambda per_token: np.add.reduceat(per_token, b.begin)
        ids = pd.Series(b.ids).astype("Int64").mask(b.null)
        return pd.DataFrame({id_col: ids, "held_out": ~b.train, "n_tokens": b.lens.astype(np.int64), "n_known": total((b.unigram > 0).astype(np.int64)), "train_tokens": np.int64(model.tokens), "base_score": total(base), "score": total(np.log10(p))})

    return grouped.applyInPandas(run, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, cutoff: int = CUTOFF, block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    The model of n-grams up to ``order`` words learns from all documents that
    aren't held out. Null and empty texts are their end alone. Rows that repeat
    an id count and are scored one by one. Without training documents every
    word is of the unknown class, which then has probability 1. An empty table
    gives no rows; other columns are left out.
    """
    blocks = cut(_blocks(docs, id_col, text_col, block_bytes))
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "trained", "docs"))).first()
    model, tables = Model(sums.docs, sums.trained, cutoff), []
    parts = max(1, -(-sums.tokens // part_keys))
    for _ in range(order if sums.tokens else 0):
        tables.append(cut(_table(_requests(_gather(blocks, tables), model, parts), model, parts)))
        model.learn(*_sums(tables[-1]), parts)
    return _scores(_gather(blocks, tables), model, id_col)
