"""Byte-level BPE over Arrow batches with the tokenizers library: encoding with offsets, and decoding.

A rank file gives byte strings and ranks. Each byte is written as one
printable character, so the library's BPE model works on characters; decoding
reverses that table and joins bytes, so a character that two tokens share comes
back whole. Merges are tried in the order of the rank of what they make, from
every split of a token into two tokens.

The pattern never crosses from a non-space to white space, so the stretches
between such places encode independently. Each distinct stretch of a batch is
encoded once and kept while the Python worker lives, up to ``CACHE`` stretches;
those in use stay.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from namewarden.llm.common import Recent, map_texts, process_cache, space_pieces, trim

#: Most stretches that a worker keeps, alone and beside other operators' memory; the longest one kept.
CACHE, BESIDE, CACHED_CHARS = 400_000, 100_000, 48
#: New stretches that are encoded in one run.
RUN = 512


def byte_table() -> dict[int, str]:
    """Each byte's character: itself where it is printable Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder for a rank file; ``pattern`` splits text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        shown = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        back = {c: b for b, c in table.items()}
        self.bytes_of = {r: bytes(map(back.__getitem__, shown[t])) for t, r in ranks.items()}
        self.kept = Recent(cache)
        every = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.tokens = pa.array(every, pa.large_binary())
        self.written = pa.array([b"%d," % i for i in range(len(every))], pa.large_binary())
        # by the bytes: which ids begin with a space, begin inside a character, are wholly inside one
        inside = [[x & 0xC0 == 0x80 for x in t] for t in every]
        self.spaced = np.array([t[:1] == b" " for t in every])
        self.begins_inside = np.array([x[:1] == [True] for x in inside])
        self.only_inside = np.array(list(map(all, inside)))

    @classmethod
    def load(cls, path: str, pattern: str, cache: int = CACHE) -> ByteBpe:
        """The worker's encoder for this file, built once."""
        known = process_cache()
        # a task has one core, so the library gets no threads
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if (path, pattern, cache) not in known:
            known[path, pattern, cache] = cls(read_ranks(path), pattern, cache)
            trim()
        return known[path, pattern, cache]

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut before every space that follows a non-space."""
        if re.search(r"\s ", text):
            return re.split(r"(?<=\S)(?= )", text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def made(self, new: list[str]) -> list[bytes]:
        """The packed ids of stretches.

        Those that begin with their only space and end in a non-space are
        encoded in runs, where each begins with the token that has its space;
        others, and runs that don't fall apart so, one by one.
        """
        joins = [s[:1] == " " and s.count(" ") == 1 and not s[1:2].isspace() and not s[-1].isspace() for s in new]
        plain = [s for s, j in zip(new, joins) if j]
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)]
        out: dict[str, bytes] = {}
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(list(map("".join, runs)), add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(run):
                packed, at = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
                out.update(zip(run, map(packed.__getitem__, map(slice, at, at[1:]))))
        other = [s for s in new if s not in out]
        out.update((s, array("i", e.ids).tobytes()) for s, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)))
        return [out[s] for s in new]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts in a row, and where each text's begin, with the end."""
        if any(re.search(r"\s ", t) for t in texts):
            cut = list(map(self.stretches, texts))
            values, starts = pa.array([s for x in cut for s in x], pa.large_string()), np.cumsum([0, *map(len, cut)])
            coded = values.dictionary_encode()
            keys, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        else:
            # all stretches but a text's first have a space before them
            values, starts = space_pieces(texts)
            is_first = np.zeros(len(values), bool)
            is_first[starts[:-1]] = True
            coded = values.filter(pa.array(~is_first)).dictionary_encode()
            firsts = values.take(pa.array(starts[:-1])).to_pylist()
            keys = [*(" " + x for x in coded.dictionary.to_pylist()), *firsts]
            codes = np.empty(len(values), np.int64)
            codes[~is_first] = coded.indices.to_numpy()
            codes[is_first] = len(coded.dictionary) + np.arange(len(firsts))
        packed = self.kept.entries([keys], self.made, CACHED_CHARS)[0]
        ids = np.frombuffer(b"".join(packed), np.int32)
        n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        sizes = n[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat((np.cumsum(n) - n)[codes] - (ends - sizes), sizes) + np.arange(total)]
        return flat, np.concatenate([[0], ends])[starts]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every whole text."""
        ids, starts = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(starts[:-1], starts[1:])]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of every whole text, as lists."""
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    @staticmethod
    def laid(table: pa.Array, ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
        """For each text the entries of a table for its ids, one behind the other."""
        found = table.take(pa.array(ids))
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[starts].tolist()
        data = memoryview(found.buffers()[2] or b"").cast("B")
        return [data[a:b] for a, b in zip(at, at[1:])]

    def digest_batch(self, texts: list[str]) -> list[tuple[int, memoryview, memoryview, int]]:
        """For every whole text the number of its ids, these in decimal, comma-joined, the bytes that they decode to, and how many characters two or more tokens share."""
        ids, starts = self.encode_flat(texts)
        shared = self.begins_inside[ids]
        shared[1:] &= ~self.only_inside[ids[:-1]]
        counts = np.concatenate([[0], np.cumsum(shared)])[starts]
        written = [w[:-1] for w in self.laid(self.written, ids, starts)]
        return list(zip(np.diff(starts).tolist(), written, self.laid(self.tokens, ids, starts), np.diff(counts).tolist()))

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the code points [start, end) that each one has bytes of."""
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for stretch in self.stretches(text):
            e = self.tokenizer.encode(stretch, add_special_tokens=False)
            ids += e.ids
            starts += [at + a for a, _ in e.offsets]
            ends += [at + b for _, b in e.offsets]
            at += len(stretch)
        return ids, starts, ends

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for; an id outside the vocabulary is a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple = ("doc_id",), text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``keep``, ids and n_tokens, and with ``offsets`` starts and ends, for every row's whole text.

    Null and empty texts have no ids. Rows stay as many as they are, with any
    repeated ids; columns that ``keep`` doesn't name are left out.
    """

    def run(texts: list[str]) -> dict:
        bpe = ByteBpe.load(path, pattern)
        if offsets:
            ids, starts, ends = zip(*map(bpe.encode, texts))
            return {"ids": ids, "n_tokens": [len(i) for i in ids], "starts": starts, "ends": ends}
        ids = bpe.encode_arrays(texts)
        return {"ids": ids, "n_tokens": [len(i) for i in ids]}

    return map_texts(docs, run, "ids array<int>, n_tokens long" + ", starts array<int>, ends array<int>" * offsets, text_col, keep)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` and decoded: the bytes of every row's ids as a binary (null ids: empty).

    Bytes, as ids cut from a text may start or end inside a character; a whole
    text's bytes are its UTF-8.
    """
    import pandas as pd
    from pyspark.sql import types as T

    def run(frames):
        bpe = ByteBpe.load(path, pattern)
        for f in frames:
            yield pd.concat([f[list(keep)], pd.Series([bpe.decode([] if x is None else list(x)) for x in f[ids_col]], index=f.index, name="decoded", dtype=object)], axis=1)

    spec = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.BinaryType())])
    return encoded.select(*keep, ids_col).mapInPandas(run, spec)


def encode_checked(docs: DataFrame, path: str, pattern: str, keep: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, ids, n_tokens and n_bytes, and whole: the decoded ids are the text's bytes."""

    def run(texts: list[str]) -> dict:
        bpe = ByteBpe.load(path, pattern, BESIDE)
        flat, starts = bpe.encode_flat(texts)
        ids = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
        decoded = bpe.laid(bpe.tokens, flat, starts)
        return {"ids": ids, "n_tokens": [len(i) for i in ids], "n_bytes": [len(d) for d in decoded], "whole": [d == t.encode() for d, t in zip(decoded, texts)]}

    return map_texts(docs, run, "ids array<int>, n_tokens long, n_bytes long, whole boolean", text_col, keep)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_shared): every whole text encoded and its ids decoded again.

    n_shared counts the characters whose bytes lie in more than one token, as the offsets of ``encode`` show them too.
    """

    def run(texts: list[str]) -> dict:
        import hashlib

        hashed = lambda b: hashlib.sha256(b).hexdigest()
        made = ByteBpe.load(path, pattern).digest_batch(texts)
        return {
            "n_tokens": [n for n, _, _, _ in made],
            "ids_sha256": [hashed(w) for _, w, _, _ in made],
            "decoded_sha256": [hashed(d) for _, _, d, _ in made],
            "n_shared": [n for _, _, _, n in made],
        }

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_shared long", text_col, (id_col,))
