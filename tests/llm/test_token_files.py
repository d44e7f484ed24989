"""Wavelet matrices in blocks, and token files with special strings, ties and documents longer than a shard."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import wavelet
from lodestone.llm.queries import tokenizer_path


@pytest.mark.parametrize("n", [0, 1, 64, 65, 1000, 4096])
@pytest.mark.parametrize("width", [16, 32])
def test_lookups_across_blocks(monkeypatch, n, width):
    monkeypatch.setattr(wavelet, "PLANE_BLOCK", 64)
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 1, 7, 50256, 3], n).astype(np.uint16 if width == 16 else np.uint32)
    names, lengths, m = wavelet.open_shard(wavelet.pack_shard([4], np.array([n]), ids, width))
    assert (names, lengths.tolist()) == ([4], [n])
    at = np.arange(n)
    assert m.access_many(at).tolist() == ids.tolist()
    for value in (0, 7, 50256, 12, 1 << width):
        places = np.flatnonzero(ids == value)
        a = rng.integers(0, n + 1, 40)
        b = np.maximum(a, rng.integers(0, n + 1, 40))
        assert m.count_many(value, a, b).tolist() == [int(((places >= x) & (places < y)).sum()) for x, y in zip(a, b)]
        assert m.find_many(value, np.arange(-1, len(places) + 1)).tolist() == [-1, *places.tolist(), -1]
    assert (m.decode() == ids).all()
    with pytest.raises(IndexError):
        m.access(n)


def test_one_lookup_reads_one_block_of_a_plane(monkeypatch):
    monkeypatch.setattr(wavelet, "PLANE_BLOCK", 1024)
    ids = np.random.default_rng(0).integers(0, 50257, 100_000).astype(np.uint16)
    _, _, m = wavelet.open_shard(wavelet.pack_shard([1], np.array([len(ids)]), ids, 16))
    assert not m.planes.held and m.access(77_777) == ids[77_777] and len(m.planes.held) <= 16


@pytest.mark.parametrize("special_as_text", [False, True])
def test_special_strings(spark, special_as_text):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)  # the plain call, unless its strings are to be ordinary text
    tok.encode_special_tokens = special_as_text
    texts = ["a <|endoftext|> b", "plain", None, "<|endoftext|>", "", "two <|endoftext|><|endoftext|> x, y.", "é ! ! !", "w " * 3000]
    rows = [(7 - i, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    want, start = [], 0
    for i, t, _ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[0], ids.count(0), start + len(ids) - 1))
        start += len(ids)
    found = wavelet.token_file(docs, path, special_as_text=special_as_text, lookups=True).collect()
    assert sorted(map(tuple, found)) == want


def test_ties_and_documents_longer_than_a_shard(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(None, "same row")] * 300 + [(None, f"row {i}") for i in range(50)] + [(3, "x y z " * 400)] * 2 + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = wavelet.new_path(spark, "ties")
    wavelet.write_shards(docs, path, target, shard_tokens=50)
    found = sorted(wavelet.documents_of(wavelet.read_shards(spark, target), lookups=True).collect(), key=lambda r: r["start"])
    assert len(found) == len(rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:])) and found[0]["start"] == 0
    assert [r["doc_id"] for r in found] == [None] * 350 + [1, 3, 3]
    assert wavelet.token_file(docs.withColumn("doc_id", F.lit(None).cast("long")), path).count() == len(rows)
