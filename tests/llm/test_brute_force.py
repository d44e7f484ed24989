"""Plain versions beside the operators: verdicts of repetition, the network one byte at a time, and the whole pipeline row by row."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import langid, mixing, pii, repetition, sentencepieces
from lodestone.llm.queries import tokenizer_path
from test_texts import prose, simple_fingerprint


def repeated_chars(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    held = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    longest = max((n for n in range(5, len(words)) if max(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values(), default=0) > 1), default=0)
    return held, sum(len(words[i]) for i in held), longest


def test_verdicts_of_repetition(spark):
    def distinct(n, tag):
        return [f"{tag}{i}" for i in range(n)]

    block = distinct(70, "r")
    texts = [" ".join(x) for x in (distinct(50, "a"), block + distinct(700, "b") + block, distinct(30, "c") * 2, block[:12] + distinct(200, "d") + block[:12], ["longerwords"] * 7 + distinct(33, "e"), distinct(9, "f"), block[:61] + distinct(900, "g") + block[:61], block[:60] + distinct(900, "h") + block[:60])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in repetition.repetition(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        held, chars, longest = repeated_chars(words)
        failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
        fine = longest <= repetition.MAX_LONGEST and 100 * chars <= repetition.MAX_CHAR_PERCENT * sum(map(len, words))
        assert (r["repeat_chars"], r["longest_repeat"], r["base_failed"], r["kept"]) == (chars, longest, failed, not failed and fine), r["doc_id"]


def simple_predict(model, text):
    """One byte after the other, in double precision."""
    raw = (text or "").encode()
    if not any(map(str.isalpha, text or "")):
        return langid.UNKNOWN, 0.0
    sums, h_ = np.zeros(len(model.langs)), model.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for a in range(0, len(raw), langid.WINDOW):
        window = raw[a : a + langid.WINDOW]
        states = []
        for d, order in ((0, window), (1, window[::-1])):
            h, own = np.zeros(h_), []
            for byte in order:
                x, u = model.tables[d][:, byte].astype(float), model.recurrent[d].astype(float) @ h
                z, r = sigmoid(x[:h_] + u[:h_]), sigmoid(x[h_ : 2 * h_] + u[h_ : 2 * h_])
                n = np.tanh(x[2 * h_ :] + r * u[2 * h_ :])
                h = (1 - z) * n + z * h
                own.append(h)
            states.append(own if d == 0 else own[::-1])
        for t, byte in enumerate(window):
            if langid._LETTER[byte]:
                score = model.out[0] @ states[0][t] + model.out[1] @ states[1][t] + model.bias[:, 0]
                e = np.exp(score - score.max())
                sums += e / e.sum()
    return model.langs[int(sums.argmax())], sums.max() / sums.sum()


def test_the_network_one_byte_at_a_time():
    model = langid.new_model([f"l{i}" for i in range(11)], seed=4)  # more states than for few languages
    texts = ["the quick brown fox", "é" * 90, "12 a", "x" * 64, "x" * 65, "日本語 text", None, "", "123", prose(150, 1)]
    langs, scores = langid.predict(model, texts)
    assert model.hidden > langid.HIDDEN
    for text, lang, score in zip(texts, langs, scores):
        want, p = simple_predict(model, text)
        assert lang == want and score == pytest.approx(p, abs=1e-4)


def simple_mask(text, spans):
    out, at = "", 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += text[at:s] + f"<{kind.upper()}>"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_row_by_row(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(6)
    lines = [prose(40, 100 + i) for i in range(50)]
    lines += [lines[3], lines[3].upper(), lines[7] + " extra", "write to ann@b.org or +1 212 555 1234 " + prose(30, 7), "server 10.0.0.1 " + prose(20, 8), "123 456", None, "zz qq xx"]
    rows = [(i, t, "en" if i % 5 else "fr", f"s{rng.integers(0, 3)}", 0) for i, t in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outputs = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs.append([r.asDict() for r in docs.collect()])
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")

    # language: kept where the network, byte by byte, knows it
    model = langid.fit(source)
    known = {i: simple_predict(model, t) for i, t, *_ in rows}
    sure = [r for r in rows if known[r[0]][0] != "und" and known[r[0]][1] >= 0.4]
    assert sorted(r["doc_id"] for r in outputs[0]) == [r[0] for r in sure]
    # near-dedup: the smallest id of every component, by all pairs
    prints = {r[0]: simple_fingerprint(r[1]) for r in sure}
    least = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    least[i] = least[j] = min(least[i], least[j])
    assert sorted(r["doc_id"] for r in outputs[1]) == sorted(set(least.values()))
    # personal data: spans cut out one by one
    second = spark.read.parquet(f"{tmp_path}/1")
    spans = {r["doc_id"]: [(int(s), int(e), k) for k, s, e in (x.split(":") for x in filter(None, r["spans"].split(",")))] for r in pii.personal_data(second).collect()}
    texts = {r["doc_id"]: r["text"] for r in outputs[1]}
    assert {r["doc_id"]: r["text"] for r in outputs[2]} == {i: simple_mask(t, spans[i]) for i, t in texts.items()}
    # mixing: as many copies as the plan's words need, in the order of their positions
    plan = {r["doc_id"]: r for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    copies = Counter(r["doc_id"] for r in outputs[3])
    for i, r in plan.items():
        assert copies[i] == -(-r["taken"] // r["size"])
    # pieces: each text by itself
    codec = sentencepieces.codec(tokenizer_path("piece_bpe_32k.model"))
    masked = {r["doc_id"]: r["text"] for r in outputs[2]}
    assert len(outputs[4]) == len(outputs[3])
    for r in outputs[4]:
        flat, _ = codec.encode([masked[r["doc_id"]]])
        assert r["round_trip"] and r["n_pieces"] == len(flat) and r["ids_crc32"] == zlib.crc32(flat.astype("<u4").tobytes())


def test_pipeline_of_empty_and_null_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3), ("repeats", [(1, "la le li lo lu", "aa", "s", 1)] * 4 + [(None, "la le li lo lu", None, None, None)])):
        docs = spark.createDataFrame(rows, schema)
        for k, (stage_name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == len(pipeline.STAGES) - 1 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], stage_name
            if stage_name == "simhash_near_dedup":
                assert docs.count() == (1 if name == "repeats" else 0)
