"""Keyword search: BM25 over an inverted index of tables, with a boolean and phrase query language.

Grammar, loosest first: ``OR``; ``AND`` (also between words that stand side by side); ``NOT``; then words, ``prefix*``, ``"a phrase"``, ``a + b``
(a phrase as well), ``^first``, ``NEAR(a b, 10)``, ``text:`` before any of these, and parentheses. A word outside quotes consists of letters,
digits and underscores. Each word, prefix or phrase outside the right side of a NOT is scored:
``-idf * f * (k1 + 1) / (f + k1 * (1 - b + b * D / avgdl))``, idf floored at 1e-6; lower is better.
"""

from __future__ import annotations

import atexit
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import K
from ..sources.scratch import delete, fresh_path

#: Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
NEAR_DISTANCE = 10
#: Rows of a result that the driver may hold.
MOST_KEPT = 10_000


@dataclass(frozen=True)
class Phrase:
    """Words in a row; ``prefix`` lets the last one be the beginning of a word, ``first`` ties the phrase to the start."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


Query = Phrase | Near | Node
_LEXEMES = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>\w+)|(?P<sign>[()*^+:,]))', re.UNICODE)


def parse(query: str) -> Query:
    """The query's tree; ValueError where it isn't one."""
    lexemes, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _LEXEMES.match(query, at)
        if not m:
            raise ValueError(f"syntax error near {query[at:at + 12]!r}")
        lexemes.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    tree, rest = _either(lexemes, 0)
    if rest < len(lexemes):
        raise ValueError(f"syntax error near {lexemes[rest][1]!r}")
    return tree


def _is(lexemes: list, at: int, value: str) -> bool:
    return at < len(lexemes) and lexemes[at][1] == value and lexemes[at][0] != "quoted"


def _either(lexemes: list, at: int):
    left, at = _both(lexemes, at)
    while _is(lexemes, at, "OR"):
        right, at = _both(lexemes, at + 1)
        left = Node("OR", left, right)
    return left, at


def _both(lexemes: list, at: int):
    left, at = _without(lexemes, at)
    while at < len(lexemes) and not (_is(lexemes, at, "OR") or _is(lexemes, at, ")") or _is(lexemes, at, ",")):
        right, at = _without(lexemes, at + _is(lexemes, at, "AND"))
        left = Node("AND", left, right)
    return left, at


def _without(lexemes: list, at: int):
    left, at = _single(lexemes, at)
    while _is(lexemes, at, "NOT"):
        right, at = _single(lexemes, at + 1)
        left = Node("NOT", left, right)
    return left, at


def _single(lexemes: list, at: int):
    if _is(lexemes, at, "("):
        tree, at = _either(lexemes, at + 1)
        if not _is(lexemes, at, ")"):
            raise ValueError("a closing parenthesis is missing")
        return tree, at + 1
    if at + 1 < len(lexemes) and lexemes[at][0] == "word" and _is(lexemes, at + 1, ":"):
        if lexemes[at][1].lower() != "text":
            raise ValueError(f"no column {lexemes[at][1]!r}")
        return _single(lexemes, at + 2)
    if _is(lexemes, at, "NEAR") and _is(lexemes, at + 1, "("):
        at, phrases, distance = at + 2, [], NEAR_DISTANCE
        while at < len(lexemes) and not (_is(lexemes, at, ")") or _is(lexemes, at, ",")):
            phrase, at = _phrase(lexemes, at)
            phrases.append(phrase)
        if _is(lexemes, at, ","):
            if at + 1 >= len(lexemes) or not lexemes[at + 1][1].isdigit():
                raise ValueError("NEAR takes a number after the comma")
            distance, at = int(lexemes[at + 1][1]), at + 2
        if not _is(lexemes, at, ")") or not phrases:
            raise ValueError("NEAR is not closed")
        return (Near(tuple(phrases), distance) if len(phrases) > 1 else phrases[0]), at + 1
    return _phrase(lexemes, at)


def _phrase(lexemes: list, at: int) -> tuple[Phrase, int]:
    first = _is(lexemes, at, "^")
    at += first
    words: list[str] = []
    while True:
        if at >= len(lexemes) or lexemes[at][0] == "sign" or (lexemes[at][0] == "word" and lexemes[at][1] in ("AND", "OR", "NOT")):
            raise ValueError("a word or phrase is missing")
        kind, value = lexemes[at]
        at += 1
        words += re.findall(r"[^\W_]+", T.fold_string(value[1:-1].replace('""', '"') if kind == "quoted" else value))
        if not _is(lexemes, at, "+"):
            break
        at += 1
    prefix = _is(lexemes, at, "*")
    return Phrase(tuple(words), prefix, first), at + prefix


def phrases_of(tree: Query) -> list[tuple[Phrase, Near | None]]:
    """Scored phrases in order, with the NEAR that each stands in; the right sides of NOT have none."""
    if isinstance(tree, Phrase):
        return [(tree, None)]
    if isinstance(tree, Near):
        return [(p, tree) for p in tree.phrases]
    return phrases_of(tree.left) + (phrases_of(tree.right) if tree.op != "NOT" else [])


def index_rows(docs: DataFrame, stamp: int) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of documents: (term, id, stamp, positions), sorted by term within range partitions so that readers skip row groups; (id, stamp, n_tokens)."""
    tokens = docs.select("id", T.tokens(F.col("text")).alias("t"))
    words = tokens.select("id", F.posexplode("t").alias("pos", "term")).groupBy("term", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    of = F.lit(stamp).cast("long").alias("stamp")
    return words.select("term", "id", of, "positions").repartitionByRange("term", "id").sortWithinPartitions("term", "id"), tokens.select("id", of, F.size("t").alias("n_tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, positions): the inverted index of documents."""
    return index_rows(docs, 0)[0].select("term", "id", F.size("positions").cast("long").alias("tf"), "positions")


def _matchers(phrases: list[Phrase]) -> list[tuple[str, bool]]:
    """The distinct (word, is a prefix) of the phrases."""
    return list(dict.fromkeys((w, p.prefix and j == len(p.words) - 1) for p in phrases for j, w in enumerate(p.words)))


def _positions(tokens: Column, word: str, prefix: bool) -> Column:
    """Positions of the word, or of the words that it begins; most texts hold none and are not walked twice."""
    hit = (lambda t: t.startswith(word)) if prefix else (lambda t: t == word)
    held = F.exists(tokens, hit) if prefix else F.array_contains(tokens, word)
    places = F.filter(F.transform(tokens, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull())
    return F.when(held, places).otherwise(F.array().cast("array<int>"))


def _starts(positions: dict[tuple[str, bool], Column], phrase: Phrase) -> Column:
    """Positions at which the phrase starts: its words' positions, moved back by their places, have them in common."""
    if not phrase.words:
        return F.array().cast("array<int>")
    found = None
    for j, word in enumerate(phrase.words):
        own = positions[word, phrase.prefix and j == len(phrase.words) - 1]
        own = F.transform(own, _back(j)) if j else own
        found = own if found is None else F.array_intersect(found, own)
    return F.filter(found, lambda s: s == 0) if phrase.first else found


def _back(j: int):
    return lambda s: s - j


def _windows(near: Near, starts: dict[Phrase, Column]) -> Column:
    """Starts of the spans that hold an instance of every phrase, with at most ``distance`` other tokens; each begins at an instance."""
    begins = F.array_distinct(F.concat(*(starts[p] for p in near.phrases)))

    def full(w: Column) -> Column:
        ok = F.lit(True)
        for p in near.phrases:
            ok = ok & (F.size(F.filter(starts[p], _inside(w, _room(near), len(p.words)))) > 0)
        return ok

    return F.filter(begins, full)


def _near_hits(phrase: Phrase, near: Near, starts: dict[Phrase, Column]) -> Column:
    """Instances of the phrase inside such a span."""
    windows = _windows(near, starts)
    return F.size(F.filter(starts[phrase], lambda s: F.exists(windows, lambda w: _inside(w, _room(near), len(phrase.words))(s))))


def _room(near: Near) -> int:
    return near.distance + sum(len(p.words) for p in near.phrases)


def _inside(w: Column, room: int, length: int):
    return lambda s: (s >= w) & (s + length <= w + room)


def _matches(tree: Query, hits: dict[Phrase, Column], near_starts: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return hits[tree] > 0
    if isinstance(tree, Near):
        return F.size(_windows(tree, near_starts)) > 0
    left, right = (_matches(t, hits, near_starts) for t in (tree.left, tree.right))
    return {"AND": left & right, "OR": left | right, "NOT": left & ~right}[tree.op]


def _all_phrases(tree: Query) -> list[Phrase]:
    if isinstance(tree, Node):
        return _all_phrases(tree.left) + _all_phrases(tree.right)
    return [tree] if isinstance(tree, Phrase) else list(tree.phrases)


def search(docs: DataFrame, query: str, k: int | None = K, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """The k best rows with column ``score``, ties by id (unique). Statistics cover all rows; the predicate only decides who is ranked.

    One pass tokenizes each text once and leaves a narrow row of counts per document, without a shuffle: positions are array
    functions over the row's own tokens, and phrases intersections of shifted positions. The counts are written and read again for the
    statistics, a single row, and for the ranking; they are deleted once the k best are known. A stored index spares the pass (``search_index``).
    """
    if not query.strip():
        return docs.limit(0).withColumn("score", F.lit(0.0))
    tree = parse(query)
    matchers = _matchers(list(dict.fromkeys(_all_phrases(tree))))
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    read = docs.select("id", T.tokens(F.col("text")).alias("__t"), keep.alias("__keep"))
    read = read.select("id", "__keep", F.size("__t").alias("__d"), *(_positions(F.col("__t"), *m).alias(f"__p{i}") for i, m in enumerate(matchers)))
    totals = (F.count("*").alias("n"), F.avg("__d").alias("mean"))
    return _rank(docs, read, None, totals, tree, k, digits)


def search_index(docs: DataFrame, postings: DataFrame, lengths: DataFrame, query: str, k: int | None = K, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """As ``search``, from a stored index: only the query's terms are read of it, by predicates on their sorted column, and no text is tokenized.
    ``postings``: (term, id, stamp, positions); ``lengths``: (id, stamp, n_tokens), whose stamps tell the postings that count."""
    if not query.strip():
        return docs.limit(0).withColumn("score", F.lit(0.0))
    tree = parse(query)
    matchers = _matchers(list(dict.fromkeys(_all_phrases(tree))))
    wanted = F.lit(False)
    for word, prefix in matchers:
        wanted = wanted | (F.col("term").startswith(word) if prefix else F.col("term") == word)
    held = postings.where(wanted).join(lengths, ["id", "stamp"])
    own = lambda word, prefix: F.col("term").startswith(word) if prefix else F.col("term") == word
    none = F.array().cast("array<int>")
    places = [F.sort_array(F.flatten(F.collect_list(F.when(own(*m), F.col("positions")).otherwise(none)))).alias(f"__p{i}") for i, m in enumerate(matchers)]
    read = held.groupBy("id").agg(F.first("n_tokens").alias("__d"), *places)
    if where is None:
        read = read.withColumn("__keep", F.lit(True))
    else:
        read = read.join(docs.where(where).select("id", F.lit(True).alias("__keep")), "id", "left").withColumn("__keep", F.coalesce("__keep", F.lit(False)))
    return _rank(docs, read, lengths.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean")), None, tree, k, digits)


def _rank(docs: DataFrame, read: DataFrame, corpus: DataFrame | None, totals: tuple[Column, Column] | None, tree: Query, k: int | None, digits: int | None) -> DataFrame:
    """read: (id, __keep, __d, positions of each matcher). Number and mean length of all documents come from ``corpus``, or are ``totals`` over the rows."""
    every = list(dict.fromkeys(_all_phrases(tree)))
    scored = list(dict.fromkeys(phrases_of(tree)))
    positions = {m: F.col(f"__p{i}") for i, m in enumerate(_matchers(every))}
    starts = {p: _starts(positions, p) for p in every}
    counts = {p: F.size(starts[p]) for p in every}
    found = read.select(
        "id", "__d",
        *(counts[p].alias(f"__c{i}") for i, (p, _) in enumerate(scored)),
        *((_near_hits(p, near, starts) if near else counts[p]).alias(f"__f{i}") for i, (p, near) in enumerate(scored)),
        (F.col("__keep") & _matches(tree, counts, starts)).alias("__match"),
    )
    spark = docs.sparkSession
    path = fresh_path(spark, "keyword")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    frequencies = [F.coalesce(F.sum((F.col(f"__c{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(scored))]
    row = found.agg(*frequencies, *(totals or ())).first()
    size = row if corpus is None else corpus.first()
    n, mean = size["n"], size["mean"] or 1.0

    score = F.lit(0.0)
    repeats = phrases_of(tree)
    for i, p in enumerate(scored):
        df, f = row[f"df{i}"], F.col(f"__f{i}")
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0.0) or IDF_FLOOR
        score = score - repeats.count(p) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__d") / mean))
    ranked = found.where("__match").select("id", (F.round(score, digits) if digits is not None else score).alias("score"))
    if k is None or k > MOST_KEPT:
        atexit.register(delete, spark, path)  # read again whenever the result is
        ranked = ranked if k is None else ranked.orderBy("score", "id").limit(k)
        return docs.join(ranked, "id").select(*docs.columns, "score").orderBy("score", "id")
    top = ranked.orderBy("score", "id").limit(max(0, k)).collect()
    delete(spark, path)
    best = spark.createDataFrame([tuple(r) for r in top], ranked.schema)
    return docs.join(F.broadcast(best), "id").select(*docs.columns, "score").orderBy("score", "id")
