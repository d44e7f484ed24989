"""Text without spaces: bounded runs, bounded memory."""

import time

import numpy as np
import pytest

from lodestone.llm import pieces, sentencepieces
from lodestone.llm.queries import tokenizer_path
from test_others import simple_viterbi


@pytest.fixture(scope="module")
def codec():
    pytest.importorskip("sentencepiece")
    return sentencepieces.codec(tokenizer_path("piece_bpe_32k.model"))


def test_runs_are_segmented_as_whole_units(codec):
    rng = np.random.default_rng(8)
    alphabet = list("abcdeéßñ日本語中国人12。、▁the")
    units = [" " + "".join(rng.choice(alphabet, int(n))) for n in rng.integers(1, 60, 300)]
    flat, counts = codec.encode_units(units)
    ends = np.cumsum(counts)
    for u, a, b in zip(units, ends - counts, ends):
        assert flat[a:b].tolist() == simple_viterbi(codec, u), u


def test_long_text_without_spaces(codec):
    rng = np.random.default_rng(9)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 200_000)))
    start = time.time()
    flat, counts = codec.encode([text, "x" * 100_000, text[:1000]])
    assert time.time() - start < 20
    assert codec.decode(flat, counts) == [text, "x" * 100_000, text[:1000]]


def test_memory_is_bounded_in_bytes(codec, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 10_000)
    table = codec.table
    rng = np.random.default_rng(10)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(12)]
    first = [codec.encode([t])[0].tolist() for t in texts]
    assert table.bytes.sum() <= 10_000 + 4002 and [codec.encode([t])[0].tolist() for t in texts] == first
    assert table.size == len(table.bytes) == len(table.met) == len(table.lengths)
