"""The sample that language identification learns from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid


def test_cutoff_never_drops_a_language():
    for count in (1, 500, 4000, 4001, 10**6, 6 * 10**8, 10**10, 10**12):
        expected = count * langid.cutoff(count, 500) / 2**62
        assert min(count, 1990) <= expected <= max(4000, 2010) and langid.cutoff(count, 500) <= 2**62


def test_every_language_is_learned(spark):
    # 100 languages, one of them with most of the rows, some with very short texts
    rows = [(i, f"w{i} text", "hot" if i % 2 else f"l{i // 2 % 100:02d}") for i in range(4000)] + [(9000 + i, "x", "tiny") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    passages = langid.sample(docs, wanted=30)
    seen = [lang for _, lang in passages]
    assert set(seen) == {f"l{i:02d}" for i in range(100)} | {"hot", "tiny"}
    assert seen.count("hot") <= 30 * langid.WINDOWS and passages == langid.sample(docs.repartition(9), wanted=30)
    with pytest.raises(ValueError):
        langid.sample(spark.range(9000).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang"))
    with pytest.raises(ValueError):
        langid.keep_known(docs.withColumn("__lang", F.lit(1)))


def test_twenty_languages(spark):
    # each with an alphabet window of its own
    rng = np.random.default_rng(3)
    letters = [chr(97 + i) for i in range(24)]
    rows = []
    for i in range(1200):
        own = letters[i % 20 : i % 20 + 5]
        rows.append((i, " ".join("".join(rng.choice(own, 5)) for _ in range(12)), f"l{i % 20:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs).where("held_out").collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 20:02d}" for r in found]) > 0.8


def test_repeated_rows_get_equal_results(spark):
    texts = ["la le li lo", "la le li lo", "trz krz", None, "x" * 300_000, "la " * 50_000]
    docs = spark.createDataFrame([(i // 2, t, "aa" if i % 2 else "bb") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train([(b"la le li lo lu", "aa"), (b"trz krz szcz", "bb")], steps=40)
    found = langid.identify(docs.unionByName(docs), model).collect()
    assert len(found) == 12 and sorted(map(str, found[:6])) == sorted(map(str, found[6:]))
