"""Quality rules: in-document repetition by suffix array.

A suffix array over the words of a block of documents is built by prefix doubling; the longest common prefixes of
neighbouring suffixes give, for every word position, the deepest LCP interval that holds its suffix and so the longest
maximal repeat that starts there. The union of those spans and the longest of them are held against limits.
Everything is a map over rows: no shuffle, memory bounded by a block of words (one text at least).

Defined cases: a null or blank text has no words, counts zero and fails the base rule; repeated rows are judged one by
one; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, slices

SYMBOLS = "#*$%&|<>"
#: Words in the shortest repeat that counts.
MIN_REPEAT = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Verdict of the method: no repeat is longer than so many words, and repeats hold at most so much of the characters in words.
MAX_LONGEST = 60
MAX_CHAR_PERCENT = 20
_BLOCK_BYTES = 4 << 20
_PACK = 21


def suffix_ranks(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by the first 1, 2, 4, ... keys.

    ``keys`` holds dense integers; equal keys occur in one document only. ``ends`` is each position's end of document.
    Suffixes already alone in their group are not sorted again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable") if n >> _PACK else np.sort((keys << _PACK) | np.arange(n)) & ((1 << _PACK) - 1)
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    heads = np.flatnonzero(new)
    sa = order
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(heads, np.diff(np.r_[heads, n]))
    levels = [rank]
    width = 1
    while True:
        sizes = np.diff(np.r_[np.flatnonzero(new), n])
        shared = np.repeat(sizes > 1, sizes)
        active = sa[shared]
        if not len(active):
            return sa, levels
        after = active + width
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[active]
        if n >> _PACK:
            by = np.lexsort((second, first))
        else:
            by = np.sort((first << (_PACK + _PACK)) | (second << _PACK) | np.arange(len(active))) & ((1 << _PACK) - 1)
        active, first, second = active[by], first[by], second[by]
        starts = np.r_[True, first[1:] != first[:-1]]
        run = np.flatnonzero(starts)
        slot = first + np.arange(len(active)) - np.repeat(run, np.diff(np.r_[run, len(active)]))
        split = starts | np.r_[True, second[1:] != second[:-1]]
        at = np.flatnonzero(split)
        rank = rank.copy()
        rank[active] = np.repeat(slot[at], np.diff(np.r_[at, len(active)]))
        sa = sa.copy()
        sa[slot] = active
        new = new.copy()
        new[slot[at]] = True
        levels.append(rank)
        width *= 2


def longest_repeats(keys: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each position the length of the longest repeat of at least ``least`` words that starts there, else 0."""
    n = len(keys)
    reach = np.zeros(n, np.int64)
    if n < 2:
        return reach
    sa, levels = suffix_ranks(keys, ends)
    floor = max(0, least.bit_length() - 1)  # a repeat of `least` words agrees in its first 2**floor
    if len(levels) <= floor:
        return reach
    near = levels[floor]
    at = np.flatnonzero(near[sa[1:]] == near[sa[:-1]])
    p, q = sa[at], sa[at + 1]
    lcp = np.zeros(len(at), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = p + lcp, q + lcp
        ok = (a < ends[p]) & (b < ends[q])
        rank = levels[j]
        same = ok & (rank[np.where(ok, a, 0)] == rank[np.where(ok, b, 0)])
        lcp += same << j
    lcp[lcp < least] = 0
    np.maximum.at(reach, p, lcp)
    np.maximum.at(reach, q, lcp)
    return reach


def covered(reach: np.ndarray) -> np.ndarray:
    """Positions in the union of the spans [p, p + reach[p])."""
    n = len(reach)
    far = np.maximum.accumulate(np.where(reach > 0, np.arange(n) + reach, 0)) if n else reach
    return far > np.arange(n)


def block_statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of :func:`repetition` for a block of texts."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat: list[bytes] = [w for ws in words for w in ws]
    out = {
        "n_words": counts,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(lines) - len(set(lines)) for lines in ([x for x in t.split("\n") if x.strip(BLANKS)] for t in texts)], np.int64),
    }
    repeated, chars, longest = (np.zeros(len(texts), np.int64) for _ in range(3))
    if flat:
        own = np.empty(len(flat), object)
        own[:] = flat
        codes, names = pd.factorize(own)
        doc = np.repeat(np.arange(len(texts)), counts)
        ends = np.repeat(np.cumsum(counts), counts)
        pairs, keys = np.unique(doc * len(names) + codes, return_inverse=True)
        reach = longest_repeats(keys.astype(np.int64), ends, MIN_REPEAT)
        held = covered(reach)
        repeated = np.bincount(doc[held], minlength=len(texts))
        lengths = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in names.tolist()], np.int64)
        chars = np.bincount(doc[held], weights=lengths[codes[held]], minlength=len(texts)).astype(np.int64)
        some = counts > 0
        longest[some] = np.maximum.reduceat(reach, (np.cumsum(counts) - counts)[some])
    return out | {"n_repeat_words": repeated, "repeat_chars": chars, "longest_repeat": longest}


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat, base_failed, kept."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars long, longest_repeat long, base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, _BLOCK_BYTES):
                x = block_statistics(texts.slice(a, b - a).to_pylist())
                failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
                fine = (x["longest_repeat"] <= MAX_LONGEST) & (100 * x["repeat_chars"] <= MAX_CHAR_PERCENT * x["word_chars"])
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat"]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(x[k], pa.int64()) for k in names), pa.array(failed), pa.array(~failed & fine)], names=["doc_id", *names, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(judge, schema)
