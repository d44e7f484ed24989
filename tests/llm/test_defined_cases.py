"""Every operator: nulls in any column, very long and empty texts, ties and repeated rows, empty tables, further columns with the output's names."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, license_scan, mixing, pii, repetition, sentencepieces, simhash, tool_calls, topk, wavelet
from lodestone.llm.queries import tokenizer_path

LONG = "la le li lo lu " * 30_000
TEXTS = [None, "", " \n", LONG, "x" * 200_000, "a b c", "a b c", "Released under the MIT License.", "mail a@b.co now please", "日本語 😀 é"]
CLASH = ["doc_id", "text", "source", "lang"]


def run(name, docs):
    return {
        "repetition": lambda: repetition.repetition(docs),
        "license": lambda: license_scan.scan(docs),
        "sentencepiece": lambda: sentencepieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")),
        "mixing": lambda: mixing.mix(docs),
        "mixed": lambda: mixing.mixed_documents(docs),
        "pii": lambda: pii.personal_data(docs),
        "masked": lambda: pii.mask(docs),
        "language": lambda: langid.identify(docs, langid.train([(b"la le li", "aa"), (b"x y z", "bb")], steps=3)),
        "wavelet": lambda: wavelet.token_file(docs, tokenizer_path("byte_bpe_50k.json"), lookups=True),
        "simhash": lambda: simhash.near_duplicates(docs),
        "kept": lambda: simhash.keep_one(docs),
    }[name]()


NAMES = ["repetition", "license", "sentencepiece", "mixing", "mixed", "pii", "masked", "language", "wavelet", "simhash", "kept"]
EACH_ROW = ["repetition", "sentencepiece", "mixing", "pii", "masked", "language", "wavelet", "simhash"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 4 else None, t, None if i % 3 == 0 else f"s{i % 2}", None if i % 2 else "aa") for i, t in enumerate(TEXTS)]
    rows += [rows[5]] * 3 + [(None, None, None, None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def clashing(docs, out):
    """The documents with a column of each name that the output has."""
    return docs.select(*CLASH, *(F.lit("other").alias(c) for c in out.columns if c not in CLASH))


@pytest.mark.parametrize("name", NAMES)
def test_nulls_repeats_long_texts_and_clashing_names(docs, name):
    out = run(name, docs)
    rows = sorted(map(str, out.collect()))
    if name in EACH_ROW:
        assert len(rows) == docs.count()
    if name in ("masked", "mixed", "kept"):
        assert out.columns == docs.columns
        again = run(name, docs.withColumn("size", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("k", F.lit(3))).select(*out.columns)
        assert len(again.collect()) == len(rows)
    else:
        assert sorted(map(str, run(name, clashing(docs, out)).select(*out.columns).collect())) == rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_and_tables_of_nulls(docs, name):
    assert run(name, docs.limit(0)).count() == 0
    nulls = docs.select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    out = run(name, nulls)
    assert len(out.collect()) == {"license": 0, "mixed": 0, "kept": 1}.get(name, docs.count())


def test_equal_rows_get_equal_results(docs):
    for name in ("repetition", "sentencepiece", "pii", "language", "simhash"):
        found = [str(r) for r in run(name, docs).where("doc_id = 5").collect()]
        assert len(found) == 4 and len(set(found)) == 1, name


def test_topk_with_clashing_names(spark):
    rows = [(i, [float(i), 1.0], 1, 1, 1, 1) for i in range(60)] + [(50, [50.0, 1.0], 1, 1, 1, 1), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, query_id int, rank int, score int")
    found = topk.top_k(table, table.where("vec_id % 50 = 0")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted((r for r in found if r["query_id"] == 0), key=lambda r: r["rank"])] == [(i + 1, i + 1) for i in range(5)] or all(r["score"] == 65536 for r in found if r["query_id"] == 0)


def test_tool_calls_with_clashing_names(spark):
    calls = spark.createDataFrame([(1, "a", 0, "reply", '{"turn":0,"question":"q"}', 9, 9, 9, 9), (None, None, None, None, None, None, None, None, None)], "conv_id long, call_id string, turn long, name string, arguments string, step int, value int, given int, needs int")
    results = spark.createDataFrame([(1, "a", 1, "r", 5), (1, "a", 1, "r", 5), (1, None, None, None, None)], "conv_id long, call_id string, turn long, content string, asked int")
    (row,) = tool_calls.link(calls, results, tool_calls.CHAT_SCHEMA).collect()
    assert (row["status"], row["step"], row["result_step"], row["valid"]) == ("linked", 0, 1, True)
