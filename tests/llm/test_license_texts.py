"""Whole license texts, and size bounds that follow from the Dice coefficient alone."""

from lodestone.llm import license_scan
from test_texts import prose


def scanned(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, dice string")
    return {(r["doc_id"], r["license"]): (r["dice"], r["n_passages"]) for r in license_scan.scan(rows).collect()}


def test_full_texts(spark):
    names = ["MIT-text", "ISC-text", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3", "MPL-2.0"]
    texts = [license_scan.TEMPLATES[k] for k in names]
    found = scanned(spark, texts + ["Copyright 2020 A. Nyone\n\n" + t for t in texts])
    for i in range(2 * len(names)):
        best = {k: v for (d, k), v in found.items() if d == i}
        assert best[names[i % len(names)]][0] > 0.98 and max(best.values())[0] == best[names[i % len(names)]][0]


def test_full_text_inside_a_longer_text(spark):
    found = scanned(spark, [prose(900, 1) + " " + license_scan.TEMPLATES["MIT-text"].replace("\n", " ") + " " + prose(700, 2), prose(3000, 3)])
    assert found[0, "MIT-text"][0] == 1.0 and {d for d, _ in found} == {0}


def test_repeated_words_are_no_reason_to_prune(spark):
    # many more words than the template, but the same bigrams: Dice is over sets
    notice = license_scan.TEMPLATES["MIT-notice"]
    found = scanned(spark, [" ".join([notice] * 9), "Released under the MIT License", None, "", "license"])
    assert set(found) == {(0, "MIT-notice"), (1, "MIT-notice")}
    words = license_scan.normalised_words(" ".join([notice] * 9))
    a, b = set(license_scan.bigrams(words)), set(license_scan.bigrams(license_scan.normalised_words(notice)))
    assert 2 * len(a & b) / (len(a) + len(b)) >= 0.8


def test_very_long_text(spark):
    found = scanned(spark, [prose(200_000, 4) + " released under the mit license " + prose(1000, 5)])
    assert found == {(0, "MIT-notice"): (1.0, 1)}
