"""SentencePiece encoding and decoding by batched numpy Viterbi.

The best segmentation of a unit (a run of spaces and the characters up to the next space) under the sum of piece scores.
Hashes of all substrings probe the sorted keys of the pieces at once. Units are cut where no known piece runs across, which
text without spaces needs; runs of equal length then advance together: at each character position a vectorised maximum over the lengths of the last piece stores its score and a backpointer.
Equal sums go to the longer last piece. A character without a piece of its own may stand alone at a penalty and
becomes byte pieces. No piece runs from a character into a space, so a text's ids are its units' ids in a row.

A text gets a space before it, spaces become U+2581, and a literal U+2581 becomes byte pieces: decoding gives back every
text exactly. Defined cases: a null text has no ids, as an empty one has, and decodes to an empty text; repeated rows get equal
results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pieces import PieceTable, ragged

#: U+2581 stands for a space.
SPACE = 0x2581
#: A literal U+2581; no piece holds it.
_LITERAL = 0x110000
#: Fixed value of the unigram model: how far an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_BYTES = 2 << 20
_CODECS: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.surface: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        keys, ids, scores = [], [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace("▁", " ").encode())
                if not model.is_unused(i):
                    keys.append(piece)
                    ids.append(i)
                    scores.append(model.get_score(i))
        points, lengths = _points(keys)
        hashes = self._hashes(points, np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(hashes)
        self.keys, self.ids, self.scores = hashes[order], np.array(ids)[order], np.array(scores, float)[order]
        assert (self.keys[1:] != self.keys[:-1]).all(), "two pieces share a hash"
        self.longest = int(lengths.max())
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.names = dict(zip(keys, zip(ids, scores)))
        self.surface_flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_lengths = np.array([len(s) for s in self.surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_lengths) - self.surface_lengths
        self.table = PieceTable(self.encode_units, lambda p: not p, re.compile(r"(?s) +[^ ]*"), [], np.uint16 if size <= 1 << 16 else np.uint32, True)

    @staticmethod
    def _hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Polynomial hashes of mixed code points; lengths may not be large."""
        with np.errstate(over="ignore"):
            mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            out = lengths.astype(np.uint64)
            for k in range(int(lengths.max(initial=0))):
                more = lengths > k
                out = np.where(more, out * _MULTIPLIER + mixed[np.minimum(starts + k, len(mixed) - 1)], out)
        return out

    def _probe(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longest, n): score and piece of the substrings of 1, 2, ... characters from every position; -inf where none.
        ``left`` counts the characters up to the end of the position's unit."""
        n = len(points)
        scores, pieces = np.full((self.longest, n), -np.inf), np.full((self.longest, n), -1, np.int32)
        with np.errstate(over="ignore"):
            mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            at = np.arange(n)
            partial = np.zeros(n, np.uint64)
            # the length is the hash's first term, so each length has its own sum: length * M**k + the characters' sum
            power = np.uint64(1)
            for k in range(self.longest):
                live = left[at] > k
                at, partial = at[live], partial[live]
                if not len(at):
                    break
                partial = partial * _MULTIPLIER + mixed[at + k]
                power = power * _MULTIPLIER
                key = partial + np.uint64(k + 1) * power
                found = np.searchsorted(self.keys, key)
                found[found == len(self.keys)] = 0
                hit = self.keys[found] == key
                scores[k, at[hit]], pieces[k, at[hit]] = self.scores[found[hit]], self.ids[found[hit]]
        alone = pieces[0] < 0
        scores[0, alone] = self.unknown
        return scores, pieces

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for units that begin in spaces."""
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, counts, held, start = [], [], 0, 0
        for i, u in enumerate([*units, ""]):  # blocks of bounded size
            if i == len(units) or (held and held + len(u) > 200_000):
                a, b = self._encode_block(units[start:i])
                flat.append(a)
                counts.append(b)
                start, held = i, 0
            held += len(u)
        return np.concatenate(flat), np.concatenate(counts)

    def _encode_block(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, lengths = _points(units)
        starts = np.cumsum(lengths) - lengths
        points = np.where(points == SPACE, _LITERAL, points)
        points[points == 32] = SPACE
        ends = np.repeat(starts + lengths, lengths)
        scores, pieces = self._probe(points, ends - np.arange(len(points)))
        # no known piece runs across a cut, so what lies between two cuts is segmented by itself: units of any length become short runs
        longest = 1 + np.where(pieces >= 0, np.arange(self.longest)[:, None], 0).max(0)
        reach = np.maximum.accumulate(np.arange(len(points)) + longest)
        heads = np.flatnonzero(np.r_[True, reach[:-1] <= np.arange(1, len(points))])
        runs = np.diff(np.r_[heads, len(points)])
        widest = np.maximum.reduceat(longest, heads)
        taken = np.zeros(len(points), np.int16)  # length of the piece that ends after this character
        for size in np.unique(runs).tolist():
            rows = heads[runs == size]
            if size == 1:
                taken[rows] = 1
                continue
            width = int(widest[runs == size].max())
            best = np.zeros((size + 1, len(rows)))
            for end in range(1, size + 1):
                top, back = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int16)
                for k in range(min(width, end), 0, -1):
                    sum_ = best[end - k] + scores[k - 1, rows + (end - k)]
                    more = sum_ > top
                    top, back = np.where(more, sum_, top), np.where(more, np.int16(k), back)
                best[end] = top
                taken[rows + end - 1] = back
        # follow the backpointers of all runs at once, from their last characters
        first = np.zeros(len(points), bool)
        at = heads + runs
        live = np.arange(len(heads))
        while len(live):
            at[live] -= taken[at[live] - 1]
            first[at[live]] = True
            live = live[at[live] > heads[live]]
        begin = np.flatnonzero(first)
        size = np.diff(np.r_[begin, len(points)])
        ids = pieces[size - 1, begin].astype(np.int64)
        unit = np.searchsorted(starts, begin, "right") - 1
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return ids, np.bincount(unit, minlength=len(units))
        spelled = [chr(SPACE if c == _LITERAL else c).encode("utf-8", "surrogatepass") for c in points[begin[missing]].tolist()]
        widths = np.ones(len(ids), np.int64)
        widths[missing] = [len(s) for s in spelled]
        out = np.repeat(ids, widths)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(unit, weights=widths, minlength=len(units)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of each text; empty texts have none."""
        some = [i for i, t in enumerate(texts) if t]
        counts = np.zeros(len(texts), np.int64)
        if not some:
            return np.zeros(0, self.table.dtype), counts
        flat, counts[some] = self.table.encode([texts[i] for i in some])
        return flat, counts

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of the ids."""
        flat = flat.astype(np.int64)
        sizes = self.surface_lengths[flat]
        raw = ragged(self.surface_flat, self.surface_starts[flat], sizes).tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)].tolist()
        return [raw[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip([0, *ends[:-1]], ends)]


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(strings)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.fromiter(map(len, strings), np.int64, len(strings))


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, n_byte_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        is_byte = np.zeros(len(own.surface), bool)
        is_byte[own.byte_ids] = True
        for batch in batches:
            for a, b in slices(batch.column(1), _BLOCK_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                flat, counts = own.encode(texts)
                ends = np.cumsum(counts)
                wide = flat.astype("<u4")
                marks = np.r_[0, np.cumsum(is_byte[flat])]
                decoded = own.decode(flat, counts)
                bounds = list(zip((ends - counts).tolist(), ends.tolist()))
                columns = [pa.array(counts, pa.int64()), pa.array(marks[ends] - marks[ends - counts], pa.int64()), pa.array([zlib.crc32(wide[x:y]) for x, y in bounds], pa.int64()), pa.array([len(t) for t in decoded], pa.int64()), pa.array([(t or "") == d for t, d in zip(texts, decoded)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_chars", "round_trip"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean")
