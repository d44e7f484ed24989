"""Operators over texts, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import langid, license_scan, pieces, pii, repetition, simhash, wavelet
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.xxh64 import xxh64

WORDS = "the quick brown fox jumps over a lazy dog while seven zebras drink cold water near green hills".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


EDGE = [None, "", "  \n ", "a", "b c", "x" * 3000 + " y z", "Ä b\xa0c d", "a a a a a a a a", "one\ntwo\none\n\n\ntwo words\ntwo words", "日本 語 テスト", "mail bob@x.org or +1 (212) 555-1234 at 10.0.0.1, 4111 1111 1111 1111", "tab\tand\x0bvt #*$ <|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = EDGE + [prose(n, n) for n in (30, 60, 200)] + [prose(60, 60) + " end", prose(25, 1) + "\n" + prose(25, 1)] + [EDGE[9]] * 2
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.limit(0)


def test_repetition(docs, empty):
    found = {r["doc_id"]: r for r in repetition.repetition(docs).collect()}
    for row in docs.collect():
        text = row["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        held = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = found[row["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(held) > 20 * len(words)) and not (r["kept"] and r["base_failed"])
        longest = max((n for n in range(5, len(words)) if max(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values(), default=0) > 1), default=0) if len(words) < 300 else r["longest_repeat"]
        assert r["longest_repeat"] == longest
    assert repetition.repetition(empty).count() == 0


def test_xxh64():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 4000, dtype=np.uint8).tobytes()
    lengths = np.r_[np.arange(0, 120), [500]]
    starts = rng.integers(0, 3000, len(lengths))
    assert xxh64(raw, starts, lengths).tolist() == [xxhash.xxh64_intdigest(raw[s : s + n], 42) for s, n in zip(starts, lengths)]


def simple_fingerprint(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = raw.split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(values))]


def test_simhash(docs, empty):
    rows = docs.collect()
    values = [simple_fingerprint(r["text"]) for r in rows]
    top = roots(values)
    least = {t: min((r["doc_id"] for r, u in zip(rows, top) if u == t and r["doc_id"] is not None), default=None) for t in top}
    want = sorted((str(r["doc_id"]), f"{v:016x}", least[t]) for r, v, t in zip(rows, values, top))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({v for v in least.values() if v is not None})


def test_keep_one_goes_by_row(spark):
    a, b, c, d, e = (prose(60, s) for s in range(20, 25))
    # a, b, c and d are components; 5 is an id of two unrelated texts, null ids hold copies of one another and of 9
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x"), (None, c, "x"), (None, c, "y"), (None, b, "x"), (7, d, "x"), (7, d, "x"), (7, d, None), (None, e, None), (None, e, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("3", a), ("5", b), ("None", c), ("7", d), ("None", e)])
    assert sorted(map(str, simhash.keep_one(docs.repartition(3)).collect())) == sorted(map(str, kept))


@pytest.mark.parametrize("block", [8192, 8])
def test_links_of_dense_balls(spark, block):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    values = list({center ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block)
    label = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    top = roots(values)
    want = {s: min(x for x, u in zip(signed, top) if u == t) for s, t in zip(signed, top)}
    assert {s: label.get(s, s) for s in signed} == want


def test_covering():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 31, 300).astype(np.uint64)
    own = {}
    for row, anchor in zip(*simhash.covering_anchors(x)):
        own.setdefault(int(row), set()).add(int(anchor))
        assert (int(anchor) ^ int(x[row])).bit_count() <= 2
    flipped = x ^ (np.uint64(1) << rng.integers(0, 31, 300).astype(np.uint64))
    for row, anchor in zip(*simhash.covering_anchors(flipped)):
        own[int(row)] = own[int(row)] | {-1} if int(anchor) in own[int(row)] else own[int(row)]
    assert all(-1 in s for s in own.values())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def simple_base(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, empty):
    extra = ["é a@b.c_x@y.org é 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "+1 (743) 555-3824 4111-1111-1111-1112", "x" * 4000 + "@a.b " + "1" * 4000, "a@b.c-@d.e ++12345678", "bob (at) mail (dot) com"]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    model = pii.fit(every)
    found = {r["doc_id"]: r for r in pii.personal_data(every, model).collect()}
    import hashlib

    for row in every.collect():
        base = simple_base(row["text"])
        r = found[row["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    assert masked[10] == "mail <EMAIL> or <PHONE> at <IP>, <CARD>" and masked[0] is None
    assert pii.personal_data(empty).count() == 0 and pii.mask(empty).columns == docs.columns


def test_em_learns_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.5
    right = [0.95, 0.9, 0.85, 0.6, 0.5]
    votes = [tuple(int((1 if t else -1) * (1 if rng.random() < p else -1)) for p in right) for t in truth]
    table = sorted(Counter((0, v) for v in votes).items())
    model, post = pii.em([(k, v, float(c)) for (k, v), c in table])
    assert [round(model.reliability[j][1][2], 1) for j in range(5)] == pytest.approx(right, abs=0.08)


def test_license_scan(docs, empty, spark):
    lines = ["Some text\nReleased under the MIT License.\nmore text here", "licensed under the apache license version 2.0", license_scan.TEMPLATES["MIT"].replace(", ", ",\n"), "mit license", None, ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {(r["doc_id"], r["license"]): r for r in license_scan.scan(rows).collect()}
    assert set(found) == {(0, "MIT-notice"), (1, "Apache-2.0-notice"), (2, "MIT")} and found[0, "MIT-notice"]["dice"] == 1.0
    # brute force: every passage against every template, without pruning by anchors
    for text_id, text in enumerate(lines):
        passages = {" ".join(license_scan.normalised_words(p)) for p in [*(text or "").split("\n"), text or ""]}
        for name, template in license_scan.TEMPLATES.items():
            words = license_scan.normalised_words(template)
            own = set(license_scan.bigrams(words))
            best = 0.0
            for p in passages:
                w = p.split()
                b = set(license_scan.bigrams(w))
                if b and len(words) / 1.5 <= len(w) <= len(words) * 1.5:
                    best = max(best, 2 * len(b & own) / (len(b) + len(own)))
            assert ((text_id, name) in found) == (best >= 0.8)
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0


def test_notices_inside_longer_passages(spark):
    mit = license_scan.TEMPLATES["MIT"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + prose(60, 1)
    lines = [prose(40, 2) + ". This page says how this corpus was built. Licensed under the Apache License, Version 2.0.", mit, "Released under the MIT License. Released under the MIT License.", prose(20, 3) + " released under\nthe MIT license " + prose(20, 4), "Released under the MIT License.", prose(300, 5) + " the license of the software under license"]
    found = {(r["doc_id"], r["license"]): (r["dice"], r["n_passages"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert found == {(0, "Apache-2.0-notice"): (1.0, 1), (1, "MIT"): (1.0, 1), (2, "MIT-notice"): (1.0, 1), (3, "MIT-notice"): (1.0, 1), (4, "MIT-notice"): (1.0, 1)}


def test_language(spark):
    rng = np.random.default_rng(9)
    make = {"aa": "la le li lo lu ma", "bb": "trz krz szcz prz drz grz"}
    rows = [(i, " ".join(rng.choice(make[lang].split(), 12)), lang) for i, lang in enumerate(["aa", "bb"] * 90)] + [(500, None, "aa"), (501, "123 --", None), (502, "", None), (None, "la le li la lo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held if r["doc_id"] < 500]) > 0.95
    assert {r["lang_pred"] for r in found if r["doc_id"] in (500, 501, 502)} == {"und"} and all(0 <= r["score"] <= 1 for r in found)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(1)
    model = langid.new_model(["a", "b", "c"])
    x, mask, labels = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.ones((6, 5), np.float32), np.array([0, 1, 2, 0, 1])
    mask[4:, 2] = 0
    _, grads = langid.loss_and_gradients(model, x, mask, labels)
    for p, g in zip(model.parameters(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, values = p[i], []
        for step in (0.01, -0.01):
            p[i] = old + step
            values.append(langid.loss_and_gradients(model, x, mask, labels)[0])
        p[i] = old
        assert (values[0] - values[1]) / 0.02 == pytest.approx(float(g[i]), rel=0.02)


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50257, 5000).astype(np.uint16)
    ids[::7] = 13
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    places = np.flatnonzero(ids == 13)
    assert m.count(13) == len(places) and m.count(13, 100, 2000) == ((places >= 100) & (places < 2000)).sum() and m.find(13, 20) == places[20] and m.find(13, len(places)) == -1
    names, lengths, again = wavelet.open_shard(wavelet.pack_shard([5, None], np.array([4000, 1000]), ids, 16))
    assert names == [5, None] and lengths.tolist() == [4000, 1000] and (again.decode() == ids).all()


def test_token_file(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, want = 0, []
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, wavelet.token_file(docs, path).collect()), key=lambda x: x[1]) == want
    target = wavelet.new_path(spark, "small")
    wavelet.write_shards(docs, path, target, shard_tokens=64)
    assert sorted(map(tuple, wavelet.documents_of(wavelet.read_shards(spark, target)).collect()), key=lambda x: x[1]) == want
    assert wavelet.token_file(empty, path).count() == 0


def test_piece_tables_agree_on_lists_and_arrow_columns_and_after_forgetting(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["", None, " ", "a b. a b,", "two  blanks \n and  a line\nmore.", "same same same", "  lead", "trail  ", "x" * 5000, "é ß 漢字 🙂", "same same same"]
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    table = wavelet.byte_bpe(path)
    for column in (texts, pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts, pa.large_string())):
        flat, counts = table.encode(column)
        ends = np.cumsum(counts)
        assert [flat[a:b].tolist() for a, b in zip(ends - counts, ends)] == expected
    assert table.encode([])[1].tolist() == []
