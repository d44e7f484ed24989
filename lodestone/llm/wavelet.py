"""Token-ID files: a wavelet matrix per shard.

Documents are dealt by range of doc_id and sorted in each partition, encoded, and packed into shards of about ``SHARD_TOKENS`` ids. A shard is one compressed binary value: ``width`` succinct bit-planes (the ids' bits from the
highest down, each plane in the order that the planes above leave: zeros first, stably) in blocks of ``PLANE_BLOCK`` bits, each
compressed by itself, the number of ones before every block, the number of zeros of each plane, and the documents' ids and lengths.
Token access, counting and occurrence lookup decompress the blocks that they touch, one a plane and position at most; rank and select of
many positions go together. Shards are rows of Parquet files, written by Spark's own committer: a lost executor's attempt
leaves nothing behind and any file system will do.

Defined cases: a null text is encoded as an empty one (its end id only); documents without doc_id come first; repeated
doc_ids stand in the order of a hash of their texts, and equal rows as they happen to lie, so no doc_id has to fit in one task; an empty
table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices
from .pieces import PieceTable, ragged

END_ID = 0
SHARD_TOKENS = 1 << 20
#: Shards of one file: they are read together.
FILE_SHARDS = 8
#: Bits of a plane's block.
PLANE_BLOCK = 1 << 16
_MAGIC = b"LWM2"
_BLOCK_BYTES = 4 << 20
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


class _Planes:
    """Bit-planes in blocks: ``load(k, j)`` gives the bytes of block j of plane k, which are kept once read."""

    def __init__(self, n: int, ranks: np.ndarray, load):
        self.n, self.ranks, self.load = n, ranks, load  # ranks: (planes, blocks + 1), ones before each block
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.sums: dict[tuple[int, int], np.ndarray] = {}

    def block(self, k: int, j: int) -> np.ndarray:
        if (k, j) not in self.held:
            self.held[k, j] = self.load(k, j)
        return self.held[k, j]

    def whole(self, k: int) -> np.ndarray:
        blocks = -(-self.n // PLANE_BLOCK)
        return np.concatenate([self.block(k, j) for j in range(blocks)]) if blocks else np.zeros(0, np.uint8)

    def rank(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones before the positions i of plane k."""
        out = self.ranks[k][i // PLANE_BLOCK].copy()
        inner = i % PLANE_BLOCK
        for j in np.unique((i // PLANE_BLOCK)[inner > 0]).tolist():
            own = np.flatnonzero((i // PLANE_BLOCK == j) & (inner > 0))
            raw = self.block(k, j)
            if (k, j) not in self.sums:
                self.sums[k, j] = np.r_[0, np.cumsum(np.bitwise_count(raw), dtype=np.int64)]
            byte, bit = inner[own] >> 3, inner[own] & 7
            last = raw[np.minimum(byte, len(raw) - 1)] & ((1 << bit) - 1).astype(np.uint8)
            out[own] += self.sums[k, j][byte] + np.bitwise_count(last)
        return out

    def bit(self, k: int, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for j in np.unique(i // PLANE_BLOCK).tolist():
            own = np.flatnonzero(i // PLANE_BLOCK == j)
            inner = i[own] % PLANE_BLOCK
            out[own] = self.block(k, j)[inner >> 3] >> (inner & 7).astype(np.uint8) & 1
        return out

    def select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) ones or zeros of plane k, which are there."""
        edges = np.minimum(np.arange(len(self.ranks[k])) * PLANE_BLOCK, self.n)
        before = self.ranks[k] if bit else edges - self.ranks[k]
        block = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for j in np.unique(block).tolist():
            own = np.flatnonzero(block == j)
            size = int(edges[j + 1] - edges[j])
            bits = np.unpackbits(self.block(k, j), count=size, bitorder="little")
            out[own] = j * PLANE_BLOCK + np.flatnonzero(bits == bit)[nth[own] - before[j]]
        return out


class WaveletMatrix:
    """Succinct sequence of integers below 2**width."""

    def __init__(self, planes: _Planes, zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.width = planes, zeros, n, len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> "WaveletMatrix":
        planes, zeros, n = [], [], len(ids)
        for level in range(width - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bits, bitorder="little"))
            low = np.flatnonzero(~bits)
            zeros.append(len(low))
            if level:
                ids = np.concatenate([ids.take(low), ids.take(np.flatnonzero(bits))])
        step = PLANE_BLOCK // 8
        ones = [[int(np.bitwise_count(p[a : a + step]).sum()) for a in range(0, len(p), step)] for p in planes]
        ranks = np.array([np.r_[0, np.cumsum(x, dtype=np.int64)] for x in ones], np.int64).reshape(width, -1)
        return cls(_Planes(n, ranks, lambda k, j: planes[k][j * step : (j + 1) * step]), zeros, n)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        dtype = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, dtype)
        for k in range(self.width - 1, -1, -1):
            bits = np.unpackbits(self.planes.whole(k), count=self.n, bitorder="little").view(bool)
            value, zeros = dtype(1 << (self.width - 1 - k)), self.zeros[k]
            ids[zeros:] |= value
            up = np.empty_like(ids)
            up[np.flatnonzero(~bits)] = ids[:zeros]
            up[np.flatnonzero(bits)] = ids[zeros:]
            ids = up
        return ids

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The values at positions."""
        at = np.asarray(at, np.int64)
        if len(at) and not 0 <= at.min() <= at.max() < self.n:
            raise IndexError("position outside the sequence")
        value = np.zeros(len(at), np.int64)
        for k in range(self.width):
            bit, ones = self.planes.bit(k, at), self.planes.rank(k, at)
            value = value << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return value

    def _ranges(self, value: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(self.width):
            a, b = self.planes.rank(k, start), self.planes.rank(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.width - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count_many(self, value: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of value in each [start, end)."""
        if value >> self.width:
            return np.zeros(len(start), np.int64)
        a, b = self._ranges(value, np.asarray(start, np.int64), np.asarray(end, np.int64))
        return b - a

    def find_many(self, value: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth occurrences (from 0) of value; -1 where there are fewer."""
        nth = np.asarray(nth, np.int64)
        out = np.full(len(nth), -1, np.int64)
        some = np.flatnonzero((nth >= 0) & (nth < self.count(value)))
        if len(some):
            at = self._ranges(value, np.zeros(1, np.int64), np.full(1, self.n, np.int64))[0][0] + nth[some]
            for k in range(self.width - 1, -1, -1):
                bit = value >> (self.width - 1 - k) & 1
                at = self.planes.select(k, bit, at - self.zeros[k] if bit else at)
            out[some] = at
        return out

    def access(self, i: int) -> int:
        return int(self.access_many(np.array([i]))[0])

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of value in [start, end)."""
        return int(self.count_many(value, np.array([start]), np.array([self.n if end is None else end]))[0])

    def find(self, value: int, nth: int) -> int:
        """Position of the nth occurrence (from 0) of value; -1 if there are fewer."""
        return int(self.find_many(value, np.array([nth]))[0])


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """The shard: five numbers, the compressed head (documents, zeros, ranks, sizes of blocks), the blocks."""
    matrix, packer = WaveletMatrix.build(ids, width), zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids])
    blocks = matrix.planes.ranks.shape[1] - 1
    packed = [packer.compress(matrix.planes.block(k, j).tobytes()) for k in range(width) for j in range(blocks)]
    head = [np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(known), lengths.astype("<i8"), np.array(matrix.zeros, "<i8"), matrix.planes.ranks.astype("<i8"), np.array([len(p) for p in packed], "<i8")]
    front = packer.compress(b"".join(x.tobytes() for x in head))
    return _MAGIC + np.array([len(ids), width, len(doc_ids), blocks, len(front)], "<i8").tobytes() + front + b"".join(packed)


def open_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix; no plane is decompressed yet."""
    if blob[:4] != _MAGIC:
        raise ValueError("not a shard of token ids")
    n, width, docs, blocks, front = (int(x) for x in np.frombuffer(blob, "<i8", 5, 4))
    raw = zstandard.ZstdDecompressor().decompress(blob[44 : 44 + front])
    at = 0

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype, count, at)
        at += out.nbytes
        return out

    doc_ids, known = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs)
    lengths, zeros = take("<i8", docs), take("<i8", width)
    ranks = take("<i8", width * (blocks + 1)).reshape(width, blocks + 1).astype(np.int64)
    ends = 44 + front + np.cumsum(take("<i8", width * blocks))
    starts = np.r_[44 + front, ends[:-1]]

    def load(k: int, j: int) -> np.ndarray:
        i = k * blocks + j
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[starts[i] : ends[i]]), np.uint8)

    return [d if k else None for d, k in zip(doc_ids.tolist(), known)], lengths, WaveletMatrix(_Planes(n, ranks, load), zeros.tolist(), n)


def byte_bpe(path: str) -> PieceTable:
    """Encoder with the tokenizers library, for texts without strings of special tokens, or where those are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    size = tokenizer.get_vocab_size()
    names = [tokenizer.id_to_token(i) or "" for i in range(size)]
    spaced = np.array([x.startswith("Ġ") for x in names])
    marks = {c: np.array([tokenizer.token_to_id(c)]) for c in ".,"}
    together = 512

    def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a full stop or comma after a letter or digit is a token of its own: what is before it is encoded once
        bases = [u[:-1] if u[-1:] in marks and u[0] == " " and u[-2].isalnum() and u[-2].isascii() else u for u in units]
        distinct = list(dict.fromkeys(bases))
        alone = [u.rfind(" ") != 0 for u in distinct]
        plain = [u for u, x in zip(distinct, alone) if not x]
        other = [u for u, x in zip(distinct, alone) if x]
        flat, lengths = [], []
        joined = ["".join(plain[i : i + together]) for i in range(0, len(plain), together)]
        for encoding in tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(encoding.ids, np.int64)
            first = np.flatnonzero(spaced[ids])
            flat.append(ids)
            lengths.append(np.diff(np.r_[first, len(ids)]))
        for encoding in tokenizer.encode_batch_fast(other, add_special_tokens=False):
            flat.append(np.array(encoding.ids, np.int64))
            lengths.append(np.array([len(encoding.ids)]))
        none = [np.zeros(0, np.int64)]
        flat, lengths = np.concatenate(flat or none), np.concatenate(lengths or none)
        assert len(lengths) == len(distinct), "a token ran across pieces"
        starts = np.cumsum(lengths) - lengths
        number = {u: i for i, u in enumerate(plain + other)}
        at = np.fromiter(map(number.__getitem__, bases), np.int64, len(bases))
        own = lengths[at]
        marked = np.fromiter((len(u) != len(b) for u, b in zip(units, bases)), bool, len(units))
        sizes = own + marked
        out = np.empty(int(sizes.sum()), np.int64)
        before = np.cumsum(sizes) - sizes
        out[ragged(np.arange(len(out)), before, own)] = ragged(flat, starts[at], own)
        last = np.flatnonzero(marked)
        out[(before + sizes - 1)[last]] = [marks[units[i][-1]][0] for i in last.tolist()]
        return out, sizes

    return PieceTable(encode_units, lambda p: not p or p[0].isspace(), re.compile(r"(?s).+?(?= \S|\Z)"), [END_ID], np.uint16 if size <= 1 << 16 else np.uint32, False)


class Encoder:
    """Texts to ids as the library gives them, each text's end id included. The library makes special tokens of their strings in a text, unless
    ``special_as_text``; texts that hold such a string are given to it whole."""

    def __init__(self, path: str, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.table = byte_bpe(path)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.dtype = self.table.dtype

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.zeros(len(texts), bool)
        for mark in self.special:
            odd |= pa.compute.fill_null(pa.compute.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.table.encode(texts)
        flat, counts = self.table.encode(pa.compute.if_else(pa.array(odd), pa.scalar("", texts.type), texts))
        ends = np.cumsum(counts)
        parts, at = [], 0
        for i in np.flatnonzero(odd).tolist():
            own = np.array([*self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, END_ID], self.dtype)
            parts += [flat[at : ends[i] - counts[i]], own]
            at = ends[i]
            counts[i] = len(own)
        return np.concatenate([*parts, flat[at:]]), counts


def _encoder(path: str, special_as_text: bool = True) -> Encoder:
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, special_as_text)
    return _ENCODERS[path, special_as_text]


def write_shards(docs: DataFrame, tokenizer: str, target: str, shard_tokens: int = SHARD_TOKENS, special_as_text: bool = True) -> None:
    """Encode every document and write the shards, as Parquet rows (part, seq, n_tokens, n_docs, shard), to ``target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer, special_as_text)
        width = 8 * np.dtype(encoder.dtype).itemsize
        ids, lengths, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, lengths, names, held
            blob = pack_shard(names, np.concatenate(lengths), np.concatenate(ids), width)
            row = [part, seq, held, len(names), blob]
            seq, ids, lengths, names, held = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "n_tokens", "n_docs", "shard"])

        for batch in batches:
            texts, keys = batch.column(1), batch.column(0).to_pylist()
            for at, end in slices(texts, _BLOCK_BYTES):
                flat, counts = encoder.encode(texts.slice(at, end - at))
                start, stops = at, np.cumsum(counts)
                while start < end:  # whole documents up to the shard's size
                    base = int(stops[start - at - 1]) if start > at else 0
                    fit = int(np.searchsorted(stops, base + shard_tokens - held, "right")) + at
                    fit = min(end, max(fit, start + (held == 0)))
                    if fit > start:
                        stop = int(stops[fit - at - 1])
                        ids.append(flat[base:stop])
                        lengths.append(counts[start - at : fit - at])
                        names += keys[start:fit]
                        held += stop - base
                        start = fit
                    if start < end:
                        yield flush()
        if names:
            yield flush()

    # tie orders documents of one doc_id by their texts; spread only keeps equal rows apart
    text, order = F.col("text").cast("string"), ["doc_id", "tie", "spread"]
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), spread.alias("spread"), text.alias("text"))
    sorted_docs = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = sorted_docs.mapInArrow(run, "part int, seq int, n_tokens long, n_docs long, shard binary")
    shards.write.option("compression", "none").option("maxRecordsPerFile", FILE_SHARDS).parquet(target)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_tokens long, n_docs long, shard binary").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, start): ids before each shard. Sums of partitions first, then within each partition."""
    meta = shards.select("part", "seq", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    own = meta.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("own"))
    return own.join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("start"))


def documents_of(shards: DataFrame, lookups: bool = False) -> DataFrame:
    """One row per document from its shard: doc_id, start, n_tokens, ids_crc32, and with ``lookups``, by access, counting and lookup in the
    matrix, first_id, n_end_ids (how often the end id stands in the document's ids) and end_at (where the last of them stands, counted
    from the first document)."""
    names = ["doc_id", "part", "seq", "own", "n_tokens", "ids_crc32", *(["first_id", "n_end_ids", "own_end"] if lookups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, lengths, matrix = open_shard(batch.column(2)[i].as_py())
                ends = np.cumsum(lengths)
                starts, n = ends - lengths, len(keys)
                looked = []
                if lookups:
                    upto = matrix.count_many(END_ID, np.zeros(n, np.int64), ends)
                    looked = [matrix.access_many(starts), matrix.count_many(END_ID, starts, ends), matrix.find_many(END_ID, upto - 1)]
                ids = matrix.decode().astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                where = [pa.array([batch.column(k)[i].as_py()] * n, pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *where, *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, *looked))], names=names)

    schema = ", ".join(f"{c} {'int' if c in ('part', 'seq') else 'long'}" for c in names)
    rows = shards.select("part", "seq", "shard").mapInArrow(run, schema).join(shard_starts(shards), ["part", "seq"])
    further = ["first_id", "n_end_ids", "start + own_end as end_at"] if lookups else []
    return rows.selectExpr("doc_id", "start + own as start", "n_tokens", "ids_crc32", *further)


def token_file(docs: DataFrame, tokenizer: str, special_as_text: bool = True, lookups: bool = False) -> DataFrame:
    """Write the documents' ids to the shared folder and describe every document from what is read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_shards(docs, tokenizer, path, special_as_text=special_as_text)
    return documents_of(read_shards(spark, path), lookups)
