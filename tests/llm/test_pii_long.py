"""Personal data in very long texts, and the spans that the method adds."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import pii

LONG = {
    "digits": "1" * 200_000,
    "numbers": " ".join(str(i % 97) for i in range(70_000)),
    "ips": "10.0.0.1 " * 20_000,
    "cards": "4111 1111 1111 1111, " * 10_000,
    "mails": "a@b.co " * 20_000,
}
COUNTS = {"digits": (0, 0, 0, 0), "numbers": (0, 0, 0, 0), "ips": (0, 20_000, 0, 0), "cards": (0, 0, 10_000, 0), "mails": (20_000, 0, 0, 0)}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t) for i, t in enumerate(["write to bob@x.org", "my phone +1 212 555 1234", "server 10.0.0.1 is up", "card 4111 1111 1111 1111 paid", "call 212-555-1234 now", "contact bob (at) mail (dot) com please", "version 1.2.3.4567"] * 20)]
    return pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("kind", sorted(LONG))
def test_time_is_linear_in_the_text(spark, model, kind):
    docs = spark.createDataFrame([(1, LONG[kind])], "doc_id long, text string")
    start = time.time()
    row = pii.personal_data(docs, model).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == COUNTS[kind]
    masked = pii.mask(docs, model).first()["text"]
    tag = {"ips": "<IP>", "cards": "<CARD>", "mails": "<EMAIL>"}.get(kind)
    assert masked.count(tag) == max(COUNTS[kind]) if tag else masked == LONG[kind]
    assert time.time() - start < 60


def test_added_spans(spark, model):
    # whatever the model takes is one of the wider patterns' matches, apart from base spans and from one another
    texts = ["call 212-555-1234 or (213) 555-1234 now, or write to bob (at) mail (dot) com", "phone 212-555-1234, mail x@y.org 10.1.1.1", "4111 1111 1111 1111 212 555 1234 5678", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs, model).collect()}
    at = lambda i, kind, part: f"{kind}:{texts[i].index(part)}:{texts[i].index(part) + len(part)}"
    assert set(filter(None, found[0].split(","))) <= {at(0, "phone", "212-555-1234"), at(0, "phone", "(213) 555-1234"), at(0, "email", "bob (at) mail (dot) com")} and found[0]
    assert {at(1, "email", "x@y.org"), at(1, "ip", "10.1.1.1")} <= set(found[1].split(","))
    for spans in filter(None, found.values()):
        ends = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(","))
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert found[3] == ""


def simple_apart(base, others):
    out = list(base)
    for x in sorted(others, key=lambda x: (x[1], x[2], x[0])):
        if all(y[2] <= x[1] or x[2] <= y[1] for y in out):
            out.append(x)
    return sorted(out)


def test_overlaps_against_brute_force(spark):
    import random

    draw = random.Random(5)
    rows = []
    for i in range(60):
        make = lambda n: [(draw.randrange(4), s, s + draw.randrange(1, 12)) for s in draw.choices(range(120), k=n)]
        rows.append((i, sorted(set(make(i % 9))), sorted(set(make(i % 40)))))
    spans = "array<struct<k:int,s:int,e:int>>"
    got = spark.createDataFrame(rows, f"i int, base {spans}, others {spans}").select("i", pii._apart(F.col("base"), F.col("others")).alias("x")).collect()
    for r in got:
        assert [tuple(x) for x in r["x"]] == simple_apart(rows[r["i"]][1], rows[r["i"]][2])


def test_masks_across_pieces(spark, model, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    monkeypatch.setattr(pii, "SCAN_BLOCK", 2)
    texts = ["é" * 20 + " a@b.co " + "日" * 33 + " 10.0.0.1 x@y.org end", "a@b.co", "no", "x 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    assert out == {0: "é" * 20 + " <EMAIL> " + "日" * 33 + " <IP> <EMAIL> end", 1: "<EMAIL>", 2: "no", 3: "x <IP>"}
    with pytest.raises(ValueError):
        pii.mask(docs.withColumn("__c", F.lit(1)), model)
