"""Texts to token ids by way of their distinct space-separated pieces.

Both tokenizers here never let a token run across the start of a piece (a space and what follows it), so a text's ids
are its pieces' ids in a row. Each piece is encoded once per worker; a text is then a lookup and a gather.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Distinct pieces, and their bytes, that a worker remembers before it forgets those met once: bounds on memory only. Text without
#: spaces is a piece of its own, however long.
REMEMBERED = 700_000
REMEMBERED_BYTES = 48 << 20


class _Numbers(dict):
    """Numbers whole units as they are first asked for."""

    def __init__(self, table: "PieceTable"):
        super().__init__()
        self.table = table

    def __missing__(self, key: str) -> int:
        number = self.table.size + len(self.table.pending)
        self.table.pending.append((key, False))
        self[key] = number
        return number


class PieceTable:
    """``encode_units`` gives flat ids and lengths of units (pieces with their leading blanks). ``split`` cuts a text
    that holds an odd piece, one whose own leading space may join its neighbour, into units."""

    def __init__(self, encode_units: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], is_odd: Callable[[str], bool], split: re.Pattern, end: list[int], dtype, leading_space: bool):
        self.encode_units, self.is_odd, self.split, self.end, self.dtype, self.leading_space = encode_units, is_odd, split, end, dtype, leading_space
        self._clear()

    def _clear(self) -> None:
        self.size, self.pending = 0, []
        self.whole = _Numbers(self)
        # pieces after a space stay in Arrow, which looks up a whole block at once
        self.keys, self.key_numbers = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        self.flat, self.lengths, self.odd = np.asarray(self.end, self.dtype), np.array([len(self.end)], np.int64), np.zeros(1, bool)
        self.size = 1  # number 0 is the end of a document
        self.met = np.zeros(1, np.int64)
        self.bytes = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the pieces met most often, half of REMEMBERED and of REMEMBERED_BYTES at most."""
        keep = np.flatnonzero(self.met > 1)
        keep = keep[np.argsort(-self.met[keep], kind="stable")[: REMEMBERED // 2]]
        keep = np.sort(keep[np.cumsum(self.bytes[keep]) <= REMEMBERED_BYTES // 2])
        keep = np.r_[0, keep[keep > 0]]
        new = np.full(self.size, -1)
        new[keep] = np.arange(len(keep))
        held = new[self.key_numbers] >= 0
        self.keys, self.key_numbers = self.keys.filter(pa.array(held)), new[self.key_numbers[held]]
        left = [(k, int(new[v])) for k, v in self.whole.items() if new[v] >= 0]
        self.whole.clear()
        self.whole.update(left)
        starts = np.cumsum(self.lengths) - self.lengths
        self.flat = ragged(self.flat, starts[keep], self.lengths[keep])
        self.lengths, self.odd, self.met, self.bytes = self.lengths[keep], self.odd[keep], self.met[keep], self.bytes[keep]
        self.size = len(keep)

    def _resolve(self) -> None:
        if not self.pending:
            return
        odd = np.array([spaced and self.is_odd(key) for key, spaced in self.pending])
        units = [" " + key if spaced else key for key, spaced in self.pending]
        lengths = np.zeros(len(units), np.int64)
        plain = np.flatnonzero(~odd)
        flat, lengths[plain] = self.encode_units([units[i] for i in plain])
        self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.odd = np.concatenate([self.odd, odd])
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int64)])
        self.bytes = np.concatenate([self.bytes, np.fromiter(map(len, units), np.int64, len(units))])
        self.size += len(units)
        self.pending = []

    def _spaced(self, pieces: pa.Array, but: np.ndarray) -> np.ndarray:
        """Numbers of pieces after a space; at the places ``but`` anything."""
        found = pa.compute.index_in(pieces, value_set=self.keys)
        new = found.is_null().to_numpy(zero_copy_only=False)
        new[but] = False
        place = found.fill_null(0).to_numpy()
        numbers = self.key_numbers[place] if len(self.key_numbers) else np.zeros(len(pieces), np.int64)
        if new.any():
            coded = pieces.filter(pa.array(new)).dictionary_encode()
            start = self.size + len(self.pending)
            self.pending += [(x, True) for x in _strings(coded.dictionary)]
            self.keys = pa.concat_arrays([self.keys, coded.dictionary])
            self.key_numbers = np.r_[self.key_numbers, np.arange(start, start + len(coded.dictionary))]
            numbers[new] = start + coded.indices.to_numpy()
        return numbers

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text, its end included. Only pieces not met before become strings."""
        if self.size > REMEMBERED or self.bytes.sum() > REMEMBERED_BYTES:
            self._forget()
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        column = _raw(texts)
        pieces = pa.compute.split_pattern(column, " ")
        counts = pa.compute.list_value_length(pieces).to_numpy().astype(np.int64)
        flattened = pieces.flatten()
        first = np.zeros(0, np.int64) if self.leading_space else np.cumsum(counts) - counts
        own = self._spaced(flattened, first)
        own[first] = [self.whole[_text(x)] for x in flattened.take(pa.array(first)).to_pylist()]
        self._resolve()
        counts += 1
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), np.int64)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # number 0 ends a text
        flat[inner] = own
        bad = np.unique(np.searchsorted(ends, np.flatnonzero(self.odd[flat]), "right")).tolist()
        if bad:
            parts, at = [], 0
            for i in bad:
                text = _text(column[i].as_py())
                units = [self.whole[u] for u in self.split.findall(" " + text if self.leading_space else text)]
                parts += [flat[at : ends[i] - counts[i]], np.array([*units, 0], np.int64)]
                at = ends[i]
                counts[i] = len(units) + 1
            flat = np.concatenate([*parts, flat[at:]])
            self._resolve()
        self.met += np.bincount(flat, minlength=self.size)
        lengths = self.lengths[flat]
        per_text = np.add.reduceat(lengths, np.cumsum(counts) - counts)
        return ragged(self.flat, (np.cumsum(self.lengths) - self.lengths)[flat], lengths), per_text


def _raw(texts: list[str | None] | pa.Array) -> pa.Array:
    """UTF-8 bytes; null texts are empty."""
    if isinstance(texts, pa.Array):
        return pa.compute.fill_null(texts, "").cast(pa.large_binary())
    return pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())


def _strings(raw: pa.Array) -> list[str]:
    try:
        return raw.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
    except pa.ArrowInvalid:  # lone surrogates
        return [_text(x) for x in raw.to_pylist()]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass")


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for all i, one after the other. ``rows`` at a time, which keeps the index arrays small."""
    out, at = np.empty(int(lengths.sum()), values.dtype), 0
    for k in range(0, len(lengths), rows):
        own = lengths[k : k + rows]
        ends = np.cumsum(own)
        n = int(ends[-1])
        np.take(values, np.repeat(starts[k : k + rows] - ends + own, own) + np.arange(n), out=out[at : at + n], mode="clip")
        at += n
    return out
