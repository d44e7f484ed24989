"""Mixing sources to target weights, as a time-varying curriculum. DataFrame functions only.

Each source's share of the mix is its target; a target over ``CAP`` times the source's size stops there and the excess
goes to the others by weight (water filling: the level is found in closed form over the sources ranked by cap / weight).
Within a source, documents stand in a fixed order drawn from a hash of id and text; the mix takes the first ``target`` words
of that order, starting again at the front for every epoch, so the words taken sum to the target and the last document
of a source may be cut.

A source's weight varies over training: ``w(t) = 1 + slope * (t - 1/2)`` for t in [0, 1]. Its integral is the share of the
source's demand that has been met by then; inverted at a document's cumulative words it gives the document's training
position, and documents are range-sorted by position. A table of one row a document (``mix``) has the position of the first copy; the mix
itself (``mixed_documents``) gives each copy its own. Prefix sums go through two levels of hash buckets, so no window holds
more than about a millionth of a source.

Defined cases: a null or blank text has size 0 and takes nothing (position null); a null source is a source of its own, ranked
last; repeated rows and rows without doc_id count like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: By the rank of a source, repeating.
WEIGHTS = (3, 1, 2)
SLOPES = (-1.0, 1.0, 0.0)
#: Of all sizes, in percent, and the most that a source gives, as a multiple of its size.
BUDGET_PERCENT = 150
CAP = 2
_BUCKETS = 1024


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, slope, target) for (source, size) rows: as many rows as sources."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = own.withColumn("__rank", rank).withColumn("__weight", _cycle(F.col("__rank"), WEIGHTS).cast("double")).withColumn("slope", _cycle(F.col("__rank"), SLOPES))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the first source, by cap / weight, that the level leaves below its cap sets the level; none: all are at their caps
    levels = (
        ranked.withColumn("__cap", (F.col("source_size") * CAP).cast("double"))
        .withColumn("__budget", F.sum("source_size").over(every) * BUDGET_PERCENT / 100)
        .withColumn("__level", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(after))
        .withColumn("__open", F.col("__level") * F.col("__weight") <= F.col("__cap"))
    )
    level = F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("__weight"), F.col("__rank"), F.col("__level").alias("at")))).over(every)["at"]
    return levels.withColumn("__at", level).select("source", "source_size", "slope", F.least("__cap", F.coalesce(F.col("__at") * F.col("__weight"), F.col("__cap"))).alias("target"))


def _prefix_sums(rows: DataFrame) -> DataFrame:
    """Adds __before: the words of the source's documents that stand earlier. rows: source, size, __h (long)."""
    keyed = rows.withColumn("__a", F.pmod("__h", F.lit(_BUCKETS))).withColumn("__b", F.pmod(F.shiftright("__h", 10), F.lit(_BUCKETS)))
    earlier = lambda *keys: Window.partitionBy("source", *keys)
    upto = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = keyed.groupBy("source", "__a", "__b").agg(F.sum("size").alias("__n"))
    large = small.groupBy("source", "__a").agg(F.sum("__n").alias("__n"))
    large = large.select("source", "__a", upto(earlier().orderBy("__a")).alias("__pa"))
    small = small.select("source", "__a", "__b", upto(earlier("__a").orderBy("__b")).alias("__pb"))
    # rows without words change no sum and take nothing: however many share a hash, they are dealt apart
    keyed = keyed.withColumn("__z", F.when(F.col("size") == 0, F.pmod(F.monotonically_increasing_id(), F.lit(_BUCKETS)) + 1).otherwise(F.lit(0)))
    own = Window.partitionBy("source", "__a", "__b", "__z").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__pc", F.coalesce(F.sum("size").over(own), F.lit(0))).drop("__z")
    on = lambda left, right, keys: left.join(right.select(*(F.col(c).alias(f"_{c}") if c in ("source", *keys) else F.col(c) for c in right.columns)), [left["source"].eqNullSafe(F.col("_source")), *(left[c] == F.col(f"_{c}") for c in keys)]).drop("_source", *(f"_{c}" for c in keys))
    placed = on(placed, small, ["__a", "__b"])
    placed = on(placed, large, ["__a"])
    return placed.withColumn("__before", F.col("__pa") + F.col("__pb") + F.col("__pc")).drop("__a", "__b", "__pa", "__pb", "__pc")


def position(share: Column, slope: Column) -> Column:
    """Training time at which a source with this slope has met ``share`` of its demand: the inverse of t + slope * (t*t - t) / 2."""
    b = 1 - slope / 2
    return 2 * share / (b + F.sqrt(F.greatest(b * b + 2 * slope * share, F.lit(0.0))))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def row_hash() -> Column:
    """The first 60 bits of an MD5, which SQL elsewhere has as well."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _planned(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, __h, __before, source_size, slope, target, taken, copies: a row for each of docs."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), row_hash().alias("__h"))
    sized = materialize(sized, "sizes")
    targets = source_targets(sized).select(F.col("source").alias("__source"), "source_size", "slope", "target")
    targets = materialize(targets, "targets")
    rows = _prefix_sums(sized)
    few = F.broadcast(targets) if targets.limit(100_001).count() <= 100_000 else targets
    rows = rows.join(few, rows["source"].eqNullSafe(F.col("__source"))).drop("__source")
    goal = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = goal - epochs * F.col("source_size")
    partly = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("__before")))
    out = rows.withColumn("taken", (epochs * F.col("size") + partly).cast("long"))
    return out.withColumn("copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long"))


def _share(copy: Column) -> Column:
    """The share of its source's demand that is met in the middle of a document's copy, counted from 0."""
    own = F.least(F.col("size"), F.col("taken") - copy * F.col("size"))
    return F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("__before") + own / 2) / F.col("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, position (of the first copy), range-sorted by position."""
    share = F.when((F.col("size") > 0) & (F.col("taken") > 0), _share(F.lit(0)))
    out = _planned(docs).withColumn("position", position(share, F.col("slope")))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "__h").select("doc_id", "size", "source_size", "target", "taken", "copies", "source", "position", F.col("__h").alias("row_hash"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with all columns, range-sorted by training position: a document stands as often as it is taken (the last
    time whole, too), each copy at a position of its own, not at all if nothing of it is taken."""
    names = docs.columns
    if {"__hash", "__source", "__plan", "__own", "__at", "__n", "__position"} & set(names):
        raise ValueError("columns __hash, __source, __plan, __own, __at, __n and __position are the operator's own")
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda e: position(_share(e), F.col("slope"))))
    plan = _planned(docs).select(F.col("__h").alias("__hash"), F.col("source").alias("__source"), "__before", F.coalesce(places, F.array().cast("array<double>")).alias("at"))
    plan = plan.groupBy("__hash", "__source").agg(F.sort_array(F.collect_list(F.struct("__before", "at"))).alias("__plan"))
    plan = materialize(plan, "plan")
    rows = docs.withColumn("__own", row_hash())
    same = (F.col("__own") == F.col("__hash")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    # rows that share id, text and source are rare: only they are numbered, each for a place in the plan of its own
    once, repeated = plan.where((F.size("__plan") == 1) & (F.size(F.col("__plan")[0]["at"]) > 0)), plan.where(F.size("__plan") > 1)
    out = rows.join(once, same).withColumn("__at", F.col("__plan")[0]["at"])
    if not repeated.isEmpty():
        number = F.row_number().over(Window.partitionBy("__hash", "__source").orderBy(F.xxhash64(*names)))
        out = out.unionByName(rows.join(repeated, same).withColumn("__n", number).withColumn("__at", F.get("__plan", F.col("__n") - 1)["at"]).drop("__n"))
    return out.withColumn("__position", F.explode("__at")).orderBy("__position", "__own").select(*names)
