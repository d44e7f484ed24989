"""Personal data: regular expressions, gazetteers and context as weak labelers. DataFrame functions only.

Candidates are the matches of each kind's base pattern (those that fail their check too) and of wider patterns. Five
labelers vote for, against, or not at all: the strict pattern, the check digits or shape, a gazetteer, the words around, and
the characters beside. Votes are counted by pattern of votes over the whole corpus (a bounded table: 3**5 a kind);
expectation-maximisation on that table estimates every labeler's reliability, and its posteriors train the final span classifier, a
logistic regression over the votes and the span's own features, which decides on the candidates outside the base. Base spans always
stay; an added span may overlap neither a base span nor an added one that starts before it.

Positions count code points, ends are exclusive. They come from the texts between matches (a split by the same pattern), so
patterns run only over texts that hold their trigger, and time is linear in the text, whatever it holds. Defined cases: a null text counts as empty; repeated rows get equal results;
an empty table trains nothing and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. A match of the first two starts where its run of characters does, or where the last match ended, which keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRIGGERS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Wider patterns: spelled-out addresses, addresses of version 6, shorter card numbers, national phone numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9(+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDE_TRIGGERS = {"email": r"[\[(](?:at|AT)[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"3[47][0-9]{2}", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}
#: Gazetteers, as patterns of a whole match.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|mil|int|io|ai|app|dev|info|biz|name|pro|co|me|tv|at|au|be|br|ca|ch|cn|cz|de|dk|es|eu|fi|fr|gr|hu|ie|il|in|it|jp|kr|mx|nl|no|nz|pl|pt|ro|ru|se|sg|sk|tr|tw|ua|uk|us|za)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[0-8]|6[0-6]|7|8[1246]|9[0-58])|\b555\b",
}
NEAR = {
    "email": r"(?i)e-?mail|contact|write to|courriel|correo|kontakt",
    "ip": r"(?i)\bip\b|address|server|host|login|logged",
    "card": r"(?i)card|visa|mastercard|amex|payment|carte|karte|tarjeta",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax|telefon|téléphone|teléfono",
}
AGAINST = r"(?i)version|sha-?[0-9]|\bid\b|isbn|token|serial|order|page"
AROUND = 40
LABELERS = 5
#: What the classifier sees of a span besides the votes: its length and its marks (neither letter nor digit), in three classes each, and whether a wider pattern found it.
FEATURES = 3
LENGTHS = {"email": (12, 32), "ip": (10, 20), "card": (16, 20), "phone": (11, 17)}
MARKS = {"email": (2, 4), "ip": (4, 8), "card": (1, 4), "phone": (2, 5)}
#: Items that a running sum takes at a time, and characters of a piece of a text whose spans are masked.
SCAN_BLOCK = 256
PIECE = 4096
EM_ROUNDS = 30
FIT_ROUNDS = 400
ACCEPT = 0.9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once. Expressions inside lambdas are evaluated wherever they are named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind> of what ``step(state, item) -> (state, out)`` gives along an array that is already evaluated. Outs are appended
    a block at a time, so a long array isn't copied for each item."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(items, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SCAN_BLOCK).cast("int"))
    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(numbers, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _spans(text: Column, pattern: str, trigger: str) -> Column:
    """array<struct<s, e, m, before, after>> of the leftmost matches; the last two are up to AROUND characters beside a match, no
    further than its neighbouring matches reach. Time is linear in the text."""
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    blank = F.lit("")

    def placed(hits: Column, between: Column, starts: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            s = F.get(starts, i)
            before = F.right(F.concat(F.coalesce(F.get(hits, i - 1), blank), F.get(between, i)), F.lit(AROUND))
            after = F.left(F.concat(F.get(between, i + 1), F.coalesce(F.get(hits, i + 1), blank)), F.lit(AROUND))
            return F.struct(s.alias("s"), (s + F.length(h)).alias("e"), h.alias("m"), before.alias("before"), after.alias("after"))

        return F.transform(hits, one)

    def starts(hits: Column, between: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.struct(F.length(F.get(between, i)).alias("b"), F.length(h).alias("h")))
        return _let(sizes, lambda z: _scan(z, F.lit(0), lambda at, x: (at + x["b"] + x["h"], at + x["b"]), "int"))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _let(F.split(text, pattern, -1), lambda between: _let(starts(hits, between), lambda st: placed(hits, between, st))))
    return F.when(text.rlike(trigger), found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _checked(m: Column, least: int) -> Column:
    """From ``least`` to 19 digits that pass Luhn; longer runs are never walked digit by digit."""
    return _let(_digits(m), lambda d: F.when(F.length(d).between(least, 19), _luhn(d)).otherwise(F.lit(False)))


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3
        low = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255
        return F.forall(F.split(m, r"\."), lambda p: F.when(small(p), low(p)).otherwise(F.lit(False)))
    if kind == "card":
        return _checked(m, 16)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return F.coalesce((out if no is None else out.when(no, -1)), F.lit(0))


def _bucket(x: Column, cuts: tuple[int, int]) -> Column:
    return F.when(x < cuts[0], 0).when(x < cuts[1], 1).otherwise(2)


def _candidates(text: Column, kind: str, wide: bool) -> Column:
    """array<struct<k, s, e, base, v0..v4, f0..f2>>; k is the kind's number."""
    spans = _spans(text, (WIDE if wide else PATTERNS)[kind], (WIDE_TRIGGERS if wide else TRIGGERS)[kind])

    def judged(x: Column) -> Column:
        m, before, after = x["m"], x["before"], x["after"]
        ok = F.lit(False) if wide else _passes(kind, m)
        shape = {"email": F.length(m) <= 254, "ip": F.length(m) >= 7, "card": _checked(m, 13), "phone": F.length(_digits(m)).between(10, 13)}[kind]
        votes = [
            F.lit(0) if wide else _vote(ok, ~ok),
            _vote(shape, ~shape),
            _vote(m.rlike(GAZETTEER[kind]), F.lit(kind in ("card", "ip")) & ~m.rlike(GAZETTEER[kind])),
            _vote(before.rlike(NEAR[kind]) | after.rlike(NEAR[kind]), before.rlike(AGAINST)),
            _vote(before.rlike(r"(?:^|[\s\p{P}])$") & after.rlike(r"^(?:$|[\s\p{P}])"), before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")),
        ]
        marks = F.length(F.regexp_replace(m, r"[\p{L}\p{N}]", ""))
        features = [_bucket(F.length(m), LENGTHS[kind]), _bucket(marks, MARKS[kind]), F.lit(int(wide))]
        numbered = [*(v.cast("int").alias(f"v{i}") for i, v in enumerate(votes)), *(f.cast("int").alias(f"f{i}") for i, f in enumerate(features))]
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), ok.alias("base"), *numbered)

    return F.transform(spans, judged)


def candidates(text: Column) -> Column:
    """All candidates of a text; empty for a null text."""
    full = F.coalesce(text, F.lit(""))
    every = [_candidates(full, kind, wide) for wide in (False, True) for kind in KINDS]
    return F.when(full.rlike(r"[0-9@(\[:]"), F.concat(*every)).otherwise(F.array().cast(_TYPE))


_TYPE = "array<struct<k:int,s:int,e:int,base:boolean," + ",".join([f"v{i}:int" for i in range(LABELERS)] + [f"f{i}:int" for i in range(FEATURES)]) + ">>"


#: (kind, votes, features, count)
Row = tuple[int, tuple[int, ...], tuple[int, ...], float]


@dataclass
class Model:
    """Reliabilities P(vote | class) by labeler, priors by kind, and the classifier's weights: by labeler and vote, by kind, feature and class."""

    prior: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))
    reliability: list[list[list[float]]] = field(default_factory=lambda: [[[1 / 3] * 3 for _ in range(2)] for _ in range(LABELERS)])
    bias: list[float] = field(default_factory=lambda: [-10.0] * len(KINDS))
    weights: list[list[float]] = field(default_factory=lambda: [[0.0] * 3 for _ in range(LABELERS)])
    span_weights: list[list[list[float]]] = field(default_factory=lambda: [[[0.0] * 3 for _ in range(FEATURES)] for _ in KINDS])


def em(table: list[tuple[int, tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> tuple[Model, list[float]]:
    """Fit reliabilities to (kind, votes, count) rows; also the posterior of each row. Votes are -1, 0, 1."""
    model = Model()
    post = [min(0.95, max(0.05, 0.5 + 0.3 * sum(votes) / LABELERS + 0.4 * votes[0])) for _, votes, _ in table]
    for _ in range(rounds):
        for k in range(len(KINDS)):
            n = sum(c for kind, _, c in table if kind == k)
            model.prior[k] = (1 + sum(c * p for (kind, _, c), p in zip(table, post) if kind == k)) / (2 + n)
        for j in range(LABELERS):
            for y in (0, 1):
                by = [1.0, 1.0, 1.0]  # a labeler starts out a little better than chance
                by[2 if y else 0] += 1.0
                for (_, votes, c), p in zip(table, post):
                    by[votes[j] + 1] += c * (p if y else 1 - p)
                model.reliability[j][y] = [x / sum(by) for x in by]
        new = []
        for kind, votes, _ in table:
            odds = math.log(model.prior[kind] / (1 - model.prior[kind]))
            odds += sum(math.log(model.reliability[j][1][v + 1] / model.reliability[j][0][v + 1]) for j, v in enumerate(votes) if v)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        post = new
    return model, post


def train(rows: list[Row]) -> Model:
    """EM over the patterns of votes, then the classifier on its posteriors, by gradient descent over the patterns of votes and features."""
    if not rows:
        return Model()
    votes: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind, v, _, count in rows:
        votes[kind, v] = votes.get((kind, v), 0.0) + count
    table = sorted((kind, v, count) for (kind, v), count in votes.items())
    model, post = em(table)
    posterior = {(kind, v): p for (kind, v, _), p in zip(table, post)}
    n_votes, n_spans = 3 * LABELERS, 3 * FEATURES
    x = np.zeros((len(rows), len(KINDS) + n_votes + len(KINDS) * n_spans))
    for i, (kind, v, f, _) in enumerate(rows):
        x[i, kind] = 1
        x[i, [len(KINDS) + 3 * j + vote + 1 for j, vote in enumerate(v)]] = 1
        x[i, [len(KINDS) + n_votes + kind * n_spans + 3 * j + c for j, c in enumerate(f)]] = 1
    goal = np.array([posterior[kind, v] for kind, v, _, _ in rows])
    share = np.array([count for *_, count in rows])
    share /= share.sum()
    w = np.zeros(x.shape[1])
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        decay = 1e-4 * w
        decay[: len(KINDS)] = 0
        w += 2.0 * (x.T @ (share * (goal - p)) - decay)
    model.bias = w[: len(KINDS)].tolist()
    model.weights = w[len(KINDS) : len(KINDS) + n_votes].reshape(LABELERS, 3).tolist()
    model.span_weights = w[len(KINDS) + n_votes :].reshape(len(KINDS), FEATURES, 3).tolist()
    return model


def fit(docs: DataFrame) -> Model:
    """Count the patterns of votes and features over all documents (a bounded table) and train."""
    fields = [f"c.v{i}" for i in range(LABELERS)] + [f"c.f{i}" for i in range(FEATURES)]
    rows = docs.select(F.explode(candidates(F.col("text").cast("string"))).alias("c")).groupBy("c.k", *fields).count().collect()
    cut = 1 + LABELERS
    return train(sorted((r[0], tuple(r[1:cut]), tuple(r[cut : cut + FEATURES]), float(r[cut + FEATURES])) for r in rows))


def _probability(model: Model, c: Column) -> Column:
    z = F.element_at(F.array(*map(F.lit, model.bias)), c["k"] + 1)
    for j in range(LABELERS):
        z = z + F.element_at(F.array(*map(F.lit, model.weights[j])), c[f"v{j}"] + 2)
    for j in range(FEATURES):
        flat = [w for of_kind in model.span_weights for w in of_kind[j]]
        z = z + F.element_at(F.array(*map(F.lit, flat)), c["k"] * 3 + c[f"f{j}"] + 1)
    return 1 / (1 + F.exp(-z))


def _apart(base: Column, others: Column) -> Column:
    """``base`` and those of ``others``, by start, that overlap neither a base span nor an added one; arrays of (k, s, e), by (k, s, e). One walk
    back for the next base span's start, one forth."""
    ordered = lambda spans, is_base: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(not is_base).alias("o"), x["e"].alias("e"), x["k"].alias("k")))

    def back(after: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["o"], after).otherwise(x["s"]), F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["k"].alias("k"), after.alias("until"))

    def forth(reach: Column, x: Column) -> tuple[Column, Column]:
        fits = ~x["o"] | ((x["s"] >= reach) & (x["e"] <= x["until"]))
        out = F.struct(fits.alias("fits"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
        return F.when(fits, F.greatest(reach, x["e"])).otherwise(reach), out

    every = F.reverse(F.array_sort(F.concat(ordered(base, True), ordered(others, False))))
    seen = _let(every, lambda a: _scan(a, F.lit((1 << 31) - 1), back, "struct<s:int,o:boolean,e:int,k:int,until:int>"))
    chosen = _let(F.reverse(seen), lambda a: _scan(a, F.lit(0), forth, "struct<fits:boolean,k:int,s:int,e:int>"))
    return F.array_sort(F.transform(F.filter(chosen, lambda x: x["fits"]), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with __base and __spans: arrays of (k, s, e), by kind and start."""
    model = model or fit(docs)
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    marked = docs.withColumn("__c", candidates(F.col("text").cast("string")))
    base = F.array_sort(F.transform(F.filter("__c", lambda x: x["base"]), plain))
    others = F.transform(F.filter("__c", lambda x: ~x["base"] & (_probability(model, x) >= ACCEPT)), plain)
    marked = marked.withColumn("__base", base).withColumn("__others", others)
    return marked.withColumn("__spans", F.when(F.size("__others") == 0, F.col("__base")).otherwise(_apart(F.col("__base"), F.col("__others")))).drop("__c", "__others")


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    of = lambda k: lambda x: x["k"] == k
    counts = [F.size(F.filter("__base", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with its spans (overlapping ones as one) as tags. The text is cut into pieces first, so that no span walks through all of it."""
    tag = lambda k: F.element_at(F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS)), k + 1)
    blank = F.lit("")

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head = lambda n: F.coalesce(F.substring(F.get(pieces, first), a % PIECE + 1, n), blank)
        tail = F.coalesce(F.substring(F.get(pieces, last), F.lit(1), b % PIECE), blank)
        inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, head(b - a)).otherwise(F.concat(head(F.lit(PIECE)), inner, tail))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["e"]), F.struct(at.alias("at"), x["s"].alias("s"), x["k"].alias("k"))

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    walked = _let(by_start, lambda a: _scan(a, F.lit(0), step, "struct<at:int,s:int,k:int>"))
    fresh = F.filter(walked, lambda x: x["s"] >= x["at"])
    end = F.array_max(F.transform(spans, lambda x: x["e"]))
    made = lambda pieces: F.concat(F.array_join(F.transform(fresh, lambda x: F.concat(between(pieces, x["at"], x["s"]), tag(x["k"]))), ""), between(pieces, end, F.length(text)))
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), made)


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, with all columns; in ``text`` every span (overlapping ones as one) becomes its kind in angle brackets, and n_chars, where there
    is one, follows. Columns named __c, __base, __others or __spans are an error."""
    names = docs.columns
    if {"__c", "__base", "__others", "__spans"} & set(names):
        raise ValueError("columns __c, __base, __others and __spans are the operator's own")
    found = find(docs, model)
    text = F.col("text").cast("string")
    some = F.size("__spans") > 0
    out = found.withColumn("text", F.when(some, _masked(text, F.col("__spans"))).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)
