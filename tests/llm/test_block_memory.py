"""A task's Python memory while texts are fingerprinted; several such workers share an executor."""

import random
import tracemalloc

from lodestone.llm import simhash


def test_fingerprint_blocks_are_small():
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randrange(10_000)}" for _ in range(550)) for _ in range(simhash._BLOCK_BYTES // 3200)]
    tracemalloc.start()
    found = simhash.block_fingerprints(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert found[:5].tolist() == simhash.block_fingerprints(texts[:5]).tolist()
