"""Token counts, with huge documents encoded in overlapping windows.

A text of over ``WINDOW`` characters is encoded window by window, each with the
offsets of its tokens; neighbours share an overlap. They are spliced between
two tokens of a run of ``SHARED`` that both windows have at the same places: a
sequence of tokens is what the merges give if all its neighbouring pairs are,
and each pair of the spliced sequence stands in one of the windows. Where there
is no such run the overlap doubles, down to the window's own start and then
over the whole rest.

Other texts are cut at spaces, where this kind of tokenizer (words apart, white
space dropped) can't join tokens; a distinct piece is encoded once per worker.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from namewarden.llm.common import Recent, map_texts, process_cache, space_pieces

#: Characters of a window and of the first overlap tried; texts longer than a window are huge. Tokens that windows share.
WINDOW, OVERLAP, SHARED = 24_576, 512, 6
#: Most pieces that a worker keeps, and the longest one kept.
CACHE, CACHED_CHARS = 600_000, 48
#: New pieces that are encoded in one run.
RUN = 512
#: What keeps ASCII text from the bare tokenizer: controls, runs of white space. Each white space.
ODD, WHITE = re.compile(r"[\x00-\x08\x0e-\x1f]|\s\s").search, re.compile(r"[\t-\r]").sub
#: Tokens above which a document is over the limit.
LIMIT = 2048


class Encoder:
    """A tokenizer without truncation or padding, beside it one without its normalizer for texts that need none.

    ASCII text is its own NFC, and lower-cased with each white space a space
    by one call: where the normalizer does no more than these and runs of white
    space don't occur, leaving it out gives the same tokens at the same places.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.bare = tokenizer, None
        tokenizer.no_truncation()
        tokenizer.no_padding()
        spec = json.loads(tokenizer.to_str())
        done = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]])
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        if len(done) == len(known) and all(x in known for x in done):
            self.bare = type(tokenizer).from_str(tokenizer.to_str())
            self.bare.normalizer = None
        self.special = [x["content"].lower() for x in spec["added_tokens"]]

    def is_plain(self, text: str) -> bool:
        """Whether the bare tokenizer serves."""
        return self.bare is not None and text.isascii() and not ODD(text) and not any(x in text.lower() for x in self.special)

    def encode(self, text: str, add_special_tokens: bool = False):
        if self.is_plain(text):
            return self.bare.encode(WHITE(" ", text).lower(), add_special_tokens=False)
        return self.tokenizer.encode(text, add_special_tokens=add_special_tokens)

    def sizes(self, pieces: list[str]) -> list[int]:
        """The number of tokens of each of some pieces without spaces, encoded in runs and told apart by the offsets."""
        n = dict.fromkeys(pieces, 0)
        plain = list(map(self.is_plain, pieces))
        for kind in (True, False):
            group = [p for p, k in zip(pieces, plain) if k is kind and p]
            for i in range(0, len(group), RUN):
                run = group[i : i + RUN]
                e = self.encode(" ".join(run))
                begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
                starts = np.cumsum([0, *(len(p) + 1 for p in run[:-1])])
                n.update(zip(run, np.bincount(np.searchsorted(starts, begins, side="right") - 1, minlength=len(run)).tolist()))
        return [n[p] for p in pieces]


def load(path: str) -> Encoder:
    """The worker's encoder for this file, loaded once; a task has one core, so the library gets no threads."""
    cache = process_cache()
    if path not in cache:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        cache[path] = Encoder(Tokenizer.from_file(path))
    return cache[path]


class Window:
    """The tokens of a part of a text that begins at ``at``; rows (id, start, end) are made of those asked for only."""

    def __init__(self, tokenizer, text: str, at: int) -> None:
        self.made, self.at = tokenizer.encode(text, add_special_tokens=False), at

    def __len__(self) -> int:
        return len(self.made)

    def first_from(self, place: int) -> int:
        """The number of the first token that begins at ``place`` or behind it."""
        return bisect_left(range(len(self)), place - self.at, key=lambda i: self.made.token_to_chars(i)[0])

    def rows(self, i: int, j: int) -> np.ndarray:
        ids, spans = self.made.ids[i:j], map(self.made.token_to_chars, range(i, j))
        return np.array([(x, a + self.at, b + self.at) for x, (a, b) in zip(ids, spans)], np.int64).reshape(-1, 3)


def _shared_run(left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """Rows of left and right in the midst of the first ``SHARED`` tokens in a row that are the same in both; None without."""
    row = lambda t: np.ascontiguousarray(t).view([("", np.int64)] * 3).ravel()
    _, i, j = np.intersect1d(row(left), row(right), return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    n = SHARED - 1
    runs = np.flatnonzero((i[n:] - i[: len(i) - n] == n) & (j[n:] - j[: len(j) - n] == n)) if len(i) > n else ()
    return (int(i[runs[0]]) + SHARED // 2, int(j[runs[0]]) + SHARED // 2) if len(runs) else None


def spliced(tokenizer, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[Window, int, int]]:
    """Windows and the numbers [i, j) of those of their tokens which in a row are the text's.

    ``overlap`` is longer than the tokenizer's longest special string, so one
    that a window cuts is whole in the other.
    """
    begin, stop = 0, min(window, len(text))
    # tokens of the window at hand count from ``own``
    left, own, seam = Window(tokenizer, text[:stop], 0), 0, None
    while stop < len(text):
        wide, at = overlap, None
        while at is None and wide < stop - begin:
            low, end = stop - wide, min(len(text), stop + window)
            right = Window(tokenizer, text[low:end], low)
            first = max(own, left.first_from(low))
            at = _shared_run(left.rows(first, len(left)), right.rows(0, right.first_from(stop)))
            wide *= 2
        if at is not None:
            yield left, own, first + at[0]
            left, own = right, at[1]
            seam = right.rows(own - SHARED // 2, own + SHARED - SHARED // 2)
            begin, stop = low, end
            continue
        # nothing to splice at: this window grows, and must still fit what is before it
        stop = min(len(text), stop + max(window, stop - begin))
        left, own = Window(tokenizer, text[begin:stop], begin), 0
        if seam is not None:
            at = _shared_run(seam, left.rows(0, len(left)))
            if at is None:
                yield None, 0, 0
                left = Window(tokenizer, text, 0)
                break
            own = at[1]
    yield left, own, len(left)


def encode_long(tokenizer, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
    """Rows (id, start, end) of every token of the text, equal to encoding it whole."""
    done: list = []
    for part, i, j in spliced(tokenizer, text, window, overlap):
        # no window: all before is void
        done = [] if part is None else [*done, part.rows(i, j)]
    return np.concatenate(done)


def count_long(tokenizer, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> int:
    """The number of tokens of the text, as ``encode_long`` has them."""
    n = 0
    for part, i, j in spliced(tokenizer, text, window, overlap):
        n = 0 if part is None else n + j - i
    return n


def count(tokenizer: Encoder, texts: list[str], kept: Recent, window: int = WINDOW, overlap: int = OVERLAP) -> list[int]:
    """The number of tokens of each whole text."""
    values, starts = space_pieces([t for t in texts if len(t) <= window])
    coded = values.dictionary_encode()
    n = np.array(kept.entries([coded.dictionary.to_pylist()], tokenizer.sizes, CACHED_CHARS)[0], np.int64)
    short = iter(np.diff(np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy()])])[starts]).tolist())
    return [next(short) if len(t) <= window else count_long(tokenizer, t, window, overlap) for t in texts]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row's whole text.

    Null and empty texts have 0 bytes and tokens. Rows keep their number,
    repeats included; other columns are left out.
    """

    def run(texts: list[str]) -> dict:
        kept = process_cache().setdefault(("counts", path), Recent(CACHE))
        n = count(load(path), texts, kept, window, overlap)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, run, "n_bytes long, n_tokens long, over_limit boolean", text_col, (id_col,))
