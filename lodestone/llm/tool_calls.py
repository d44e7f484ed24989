"""Chat formatting: tool-call linking. DataFrame functions only.

Calls and results are hash-joined by (conversation, call identifier). Calls may depend on the results of other calls; they are put
into topological order by the earliest step at which everything that they need is there: a call's step is the greatest of
its own turn and the steps of the results that it needs, a result's the greater of its own turn and its call's step, and ``depth``
orders what shares a step. A call that needs itself, if only by way of others, is in a cycle and marked ``cyclic``; what needs such a call, if
only by way of others, is ``blocked``. Needs within a cycle are left out of the order, and calls after a cycle are placed after it.

A conversation whose needs are all of earlier turns, with results there in time, is in order as it is. Of the others, those of ``SHORT`` needs
at most are solved as a row each, by array functions: sweeps over the calls in the order of their turns, up and down, until nothing moves. In longer ones steps are relaxed along the needs, from the calls that moved in the round
before only, until nothing moves: in as many rounds as the longest chain that is out of order, with no limit. Their cycles lie where some need isn't
of an earlier turn; there calls that nothing needs or that need nothing are peeled off layer by layer, and what is left is told apart by
colouring (the smallest name that reaches a call, then back from it within its colour). Tables of pairs are never made: every step holds
at most the needs themselves. Small sides are broadcast once counted; beyond, hot calls are joined apart.
Arguments are parsed as variants, held against the schema of their function, and serialised as canonical JSON (keys sorted, no blanks).

Defined cases: rows without conversation or call id are dropped from linking; of repeated call ids in a conversation the one with the smallest (turn,
name, arguments) counts, and of repeated results likewise; a call without result is ``unanswered``, a result without call an ``orphan``; arguments that
are null or no JSON object are invalid and their canonical JSON is null; a dependency on an unknown call makes a call invalid;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_hot, materialize, once

#: Function -> field -> (types of schema_of_variant, required).
Schema = dict[str, dict[str, tuple[str, bool]]]
TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY<.*>$", "object": r"^OBJECT<.*>$"}
#: The functions that turns call in ``conversation_calls``.
CHAT_SCHEMA: Schema = {
    "reply": {"question": ("string", True), "turn": ("integer", True), "needs": ("array", False)},
    "search": {"query": ("string", True), "needs": ("array", True)},
}


def _field(value: Column, name: str, kind: str, required: bool) -> Column:
    found = F.try_variant_get(value, f"$.{name}", "variant")
    right = F.schema_of_variant(found).rlike(TYPES[kind])
    return F.coalesce(F.when(found.isNull(), F.lit(not required)).otherwise(right), F.lit(False))


def valid_arguments(name: Column, value: Column, schemas: Schema) -> Column:
    """The arguments (a variant) fit the schema of the function: no field missing, of another type, or unknown."""
    out = F.lit(False)
    for function, fields in schemas.items():
        fits = F.coalesce(F.schema_of_variant(value).rlike(TYPES["object"]), F.lit(False))
        for field, (kind, required) in fields.items():
            fits = fits & _field(value, field, kind, required)
        keys = F.json_object_keys(F.to_json(value))
        known = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        fits = fits & F.coalesce(F.size(F.array_except(keys, known)) == 0, F.lit(False))
        out = F.when(name == function, fits).otherwise(out)
    return out


_NODE = ("conv_id", "call_id")
#: Needs of a conversation up to which it is solved as one row; longer ones go in rounds over all of them.
SHORT = 1024
#: Rounds of moved steps that are kept as they are before they are folded into one table.
_FOLD = 8


def _meet(left: DataFrame, right: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Inner join of stored tables on keys that are unique in ``right``, which has so many rows."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), list(keys))
    return join_hot(left, right.withColumn("__met", F.lit(True)), *keys).where("__met").drop("__met")


def _ends(edges: DataFrame, end: str, name: str = "at") -> DataFrame:
    return edges.select("conv_id", F.col(end).alias(name)).distinct()


def _peel(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges (conv_id, src, dst) that lie on a path from a cycle to a cycle, and their number."""
    size, before = edges.count(), -1
    while size and size != before:
        kept = _meet(edges, _ends(edges, "dst", "src"), size, "conv_id", "src")
        kept = _meet(kept, _ends(edges, "src", "dst"), size, "conv_id", "dst") if size <= BROADCAST_ROWS else _meet(materialize(kept, "peel"), _ends(edges, "src", "dst"), size, "conv_id", "dst")
        edges = materialize(kept.select("conv_id", "src", "dst"), "peel")
        size, before = edges.count(), size
    return edges, size


def _spread(start: DataFrame, along: DataFrame, better: bool) -> DataFrame:
    """(conv_id, at, value) at its fixed point: along edges (conv_id, src, dst) every dst learns the smallest value of its sources. Without ``better``
    a value that is there never changes."""
    known, fresh = [start], start
    few = along.count() <= BROADCAST_ROWS  # no more calls can be told anything in a round
    while True:
        n = fresh.count()
        if not n:
            break
        told = _meet(along, fresh.select("conv_id", F.col("at").alias("src"), "value"), n, "conv_id", "src")
        told = told.groupBy("conv_id", F.col("dst").alias("at")).agg(F.min("value").alias("value"))
        if not few:
            told = materialize(told, "told")
        if len(known) > _FOLD:
            known = [materialize(_smallest(known), "known")]
        old = _smallest(known).withColumnRenamed("value", "old")
        held = old.join(F.broadcast(told), ["conv_id", "at"]) if few else told.join(old, ["conv_id", "at"])
        if better:
            fresh = held.where("value < old").select("conv_id", "at", "value")
            fresh = fresh.unionByName(told.join(old, ["conv_id", "at"], "left_anti"))
        else:
            fresh = told.join(old, ["conv_id", "at"], "left_anti")
        fresh = materialize(fresh, "fresh")
        known.append(fresh)
    return materialize(_smallest(known), "known")


def _smallest(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("conv_id", "at").agg(F.min("value").alias("value"))


def _cycles(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, cycle) for every call on a cycle of edges (conv_id, src, dst): calls that lead to one another share their cycle."""
    out = edges.where("src = dst").select("conv_id", F.col("src").alias("call_id"), F.col("src").alias("cycle")).limit(0)
    left, size = _peel(edges.where("src <> dst"))
    found = []
    while size:
        nodes = materialize(_ends(left, "src"), "nodes")
        colour = _spread(nodes.withColumn("value", F.col("at")), left, True)
        mine = colour.select("conv_id", F.col("at").alias("src"), F.col("value").alias("of_src"))
        within = left.join(mine, ["conv_id", "src"]).join(mine.select("conv_id", F.col("src").alias("dst"), F.col("of_src").alias("of_dst")), ["conv_id", "dst"]).where("of_src = of_dst")
        backward = materialize(within.select("conv_id", F.col("dst").alias("src"), F.col("src").alias("dst")), "within")
        held = _spread(colour.where("at = value"), backward, False)
        found.append(held.select("conv_id", F.col("at").alias("call_id"), F.col("value").alias("cycle")))
        gone = held.select("conv_id", "at")
        rest = left.join(gone.withColumnRenamed("at", "src"), ["conv_id", "src"], "left_anti").join(gone.withColumnRenamed("at", "dst"), ["conv_id", "dst"], "left_anti")
        left, size = _peel(materialize(rest, "rest"))
    grouped = reduce(DataFrame.unionByName, found, out)
    several = grouped.groupBy("conv_id", "cycle").count().where("count > 1").drop("count")
    grouped = grouped.join(several, ["conv_id", "cycle"])
    alone = edges.where("src = dst").select("conv_id", F.col("src").alias("call_id")).distinct().join(grouped, list(_NODE), "left_anti")
    return materialize(grouped.select(*_NODE, "cycle").unionByName(alone.select(*_NODE, F.col("call_id").alias("cycle"))), "cycles")


def _ready() -> Column:
    """When a call's result is there, and how deep in that step."""
    later = F.coalesce(F.col("result_turn") > F.col("step"), F.lit(False))
    return F.struct(F.when(later, F.col("result_turn")).otherwise(F.col("step")).alias("step"), F.when(later, F.lit(0).cast("long")).otherwise(F.col("depth") + 1).alias("depth"))


def _settle(nodes: DataFrame, edges: DataFrame, max_rounds: int | None) -> DataFrame:
    """(conv_id, call_id, step, depth) for nodes (conv_id, call_id, turn, result_turn) and acyclic edges (conv_id, src, dst)."""
    start = nodes.select(*_NODE, F.col("turn").alias("step"), F.lit(0).cast("long").alias("depth"), "result_turn")
    latest = lambda tables: reduce(DataFrame.unionByName, tables).groupBy(*_NODE).agg(F.max(F.struct("step", "depth", "result_turn")).alias("s")).select(*_NODE, "s.*")
    known, fresh, n, rounds = [start], start, start.count(), 0
    active, few = edges, edges.count() <= BROADCAST_ROWS
    while True:
        told = _meet(active, fresh.select("conv_id", F.col("call_id").alias("src"), _ready().alias("ready")), n, "conv_id", "src")
        told = told.groupBy("conv_id", F.col("dst").alias("call_id")).agg(F.max("ready").alias("ready"))
        if not few:
            told = materialize(told, "told")
        if len(known) > _FOLD:
            known = [known[0], materialize(latest(known[1:]), "moved")]
        now = latest(known) if len(known) > 1 else start
        held = now.join(F.broadcast(told), list(_NODE)) if few else told.join(now, list(_NODE))
        moved = held.where(F.struct("step", "depth") < F.col("ready")).select(*_NODE, F.col("ready.step").alias("step"), F.col("ready.depth").alias("depth"), "result_turn")
        fresh = materialize(moved, "moved")
        n = fresh.count()
        if not n:
            break
        rounds += 1
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"steps did not settle in {max_rounds} rounds")
        known.append(fresh)
        if rounds == 1:  # only conversations in which something moved go on
            on = materialize(fresh.select("conv_id").distinct(), "active")
            active = materialize(edges.join(on, "conv_id", "left_semi"), "active")
    return latest(known).drop("result_turn")


def _sweep(n: Column, old: Column, value: Callable, up: bool) -> Column:
    """``value(i, at)`` of every number below n, upward or downward; ``at`` gives what this sweep has found so far, else what was before."""

    def at(done: Column, i: Column) -> Callable[[Column], Column]:
        if up:
            return lambda s: F.when(s < i, F.get(done, s)).otherwise(F.get(old, s))
        return lambda s: F.when(s > i, F.get(done, n - 1 - s)).otherwise(F.get(old, s))

    numbers = F.sequence(F.lit(0), n - 1) if up else F.sequence(n - 1, F.lit(0))
    out = F.aggregate(numbers, F.slice(old, 1, 0), lambda done, i: F.concat(done, F.array(value(i, at(done, i)))))
    return out if up else F.reverse(out)


def _fixed(n: Column, start: Column, value: Callable) -> Column:
    """The array that sweeps change no more: as many as the longest way turns round, not as it has steps."""

    def swept(s: Column, _: Column) -> Column:
        both = once(_sweep(n, s["now"], value, True), lambda a: once(_sweep(n, a, value, False), lambda b: F.struct(b.alias("now"), (b != a).alias("moved"))))
        return F.when(s["moved"], both).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), n), F.struct(start.alias("now"), F.lit(True).alias("moved")), swept)["now"]


def _named(n: Column, nodes: Column, between: Column) -> Column:
    """For every call the name of its cycle (or of itself, if it is alone in it), -1 if it isn't ``between`` cycles: the greatest number that reaches a call
    is its colour, and what leads back to that number within the colour is its cycle; what is left goes on. Logs run forward, so mostly once."""
    open_ = F.lit(-2)

    def told(names: Column, _: Column) -> Column:
        is_open = lambda i: F.get(names, i) == open_
        greatest = lambda i, at: F.when(is_open(i), F.array_max(F.concat(F.array(i), F.transform(F.get(nodes, i)["needs"], at)))).otherwise(F.lit(-1))

        def back(colour: Column) -> Column:
            start = F.transform(colour, lambda c, i: c == i)
            leads = lambda i, at: (F.get(colour, i) == i) | (is_open(i) & F.exists(F.get(nodes, i)["users"], lambda u: (F.get(colour, u) == F.get(colour, i)) & at(u)))
            return once(_fixed(n, start, leads), lambda held: F.transform(names, lambda name, i: F.when(F.get(held, i), F.get(colour, i)).otherwise(name)))

        colours = _fixed(n, F.transform(names, lambda name, i: F.when(name == open_, i).otherwise(F.lit(-1))), greatest)
        return F.when(F.exists(names, lambda name: name == open_), once(colours, back)).otherwise(names)

    start = F.transform(between, lambda c: F.when(c, open_).otherwise(F.lit(-1)))
    return F.when(F.exists(between, lambda c: c), F.aggregate(F.sequence(F.lit(1), n), start, told)).otherwise(start)


def _solved(nodes: Column) -> Column:
    """Array of (call, step, depth, cyclic, blocked) of one conversation's calls, sorted by turn; ``needs`` and ``users`` are numbers in that order."""
    of = lambda i: F.get(nodes, i)
    n = F.size(nodes)
    all_ = F.transform(nodes, lambda _: F.lit(True))
    after = _fixed(n, all_, lambda i, at: F.exists(of(i)["needs"], at))  # reached from a cycle
    before = _fixed(n, all_, lambda i, at: F.exists(of(i)["users"], at))

    def ready(u: Column, result: Column) -> Column:
        later = F.coalesce(result > u["step"], F.lit(False))
        return F.struct(F.when(later, result).otherwise(u["step"]).alias("step"), F.when(later, F.lit(0).cast("long")).otherwise(u["depth"] + 1).alias("depth"))

    def placed(reached: Column, names: Column) -> Column:
        joint = lambda i, s: (F.get(names, i) >= 0) & (F.get(names, i) == F.get(names, s))
        own = lambda x: F.struct(x["turn"].alias("step"), F.lit(0).cast("long").alias("depth"))
        due = lambda i, at: F.transform(F.filter(of(i)["needs"], lambda s: ~joint(i, s)), lambda s: once(at(s), lambda u: ready(u, of(s)["result_turn"])))
        steps = _fixed(n, F.transform(nodes, own), lambda i, at: F.array_max(F.concat(F.array(own(of(i))), due(i, at))))

        def shown(u: Column, i: Column) -> Column:
            cyclic = F.exists(of(i)["needs"], lambda s: joint(i, s))
            return F.struct(of(i)["call"].alias("call_id"), u["step"].alias("step"), u["depth"].alias("depth"), cyclic.alias("cyclic"), (F.get(reached, i) & ~cyclic).alias("blocked"))

        return F.transform(steps, shown)

    with_names = lambda a: once(once(before, lambda b: _named(n, nodes, F.transform(a, lambda x, i: x & F.get(b, i)))), lambda names: placed(a, names))
    return once(after, with_names)


def _solve(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, step, depth, cyclic, blocked) of the calls at the ends of edges, in conversations of ``SHORT`` edges at most: each is a row, and
    all is array functions over it."""
    end = lambda name, asks: F.struct(F.lit(asks).alias("asks"), F.col(name).alias("call"), F.col(f"{name}_turn").alias("turn"), F.col(f"{name}_result").alias("result_turn"))
    # as many tasks as a shuffle has, however few bytes there are: it's the functions that take time
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.repartition(tasks, "conv_id").select("conv_id", "src", "dst", F.explode(F.array(end("src", False), end("dst", True))).alias("e")).select("conv_id", "src", "dst", "e.*")
    ends = ends.withColumn("i", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn", "call")) - 1)
    ends = ends.withColumn("other", (F.sum("i").over(Window.partitionBy("conv_id", "src", "dst")) - F.col("i")).cast("int"))
    linked = [F.collect_list(F.when(F.col("asks"), F.col("other"))).alias("needs"), F.collect_list(F.when(~F.col("asks"), F.col("other"))).alias("users")]
    nodes = ends.groupBy("conv_id", "i").agg(*(F.first(c).alias(c) for c in ("call", "turn", "result_turn")), *linked)
    nodes = nodes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "call", "turn", "result_turn", "needs", "users"))).alias("nodes"))
    rows = materialize(nodes, "nodes").repartition(tasks).select("conv_id", F.explode(_solved(F.col("nodes"))).alias("v"))
    return materialize(rows.select("conv_id", "v.*"), "short")


def _solve_long(nodes: DataFrame, edges: DataFrame, max_rounds: int | None) -> DataFrame:
    """As ``_solve``, for conversations of any length, in rounds over all of them; nodes: (conv_id, call_id, turn, result_turn)."""
    late = edges.where(~F.coalesce(F.col("src_turn") < F.col("dst_turn"), F.lit(False))).select("conv_id").distinct()
    cycles = _cycles(materialize(edges.join(late, "conv_id", "left_semi").select("conv_id", "src", "dst"), "suspect"))
    edges = edges.select("conv_id", "src", "dst")
    blocked = nodes.select(*_NODE, F.lit(True).alias("blocked")).limit(0)
    if not cycles.isEmpty():
        side = lambda end: cycles.select("conv_id", F.col("call_id").alias(end), F.col("cycle").alias(f"of_{end}"))
        marked = edges.join(side("src"), ["conv_id", "src"], "left").join(side("dst"), ["conv_id", "dst"], "left")
        edges = materialize(marked.where("of_src is null or of_dst is null or of_src <> of_dst").select("conv_id", "src", "dst"), "open")
        after = _spread(cycles.select("conv_id", F.col("call_id").alias("at"), F.lit(1).alias("value")), edges, False)
        blocked = after.select("conv_id", F.col("at").alias("call_id"), F.lit(True).alias("blocked"))
    steps = _settle(nodes, edges, max_rounds)
    out = steps.join(cycles.select(*_NODE, F.lit(True).alias("cyclic")), list(_NODE), "left").join(blocked, list(_NODE), "left")
    is_cyclic = F.coalesce("cyclic", F.lit(False))
    return out.select(*_NODE, "step", "depth", is_cyclic.alias("cyclic"), (F.coalesce("blocked", F.lit(False)) & ~is_cyclic).alias("blocked"))


def link(calls: DataFrame, results: DataFrame, schemas: Schema, needs_field: str = "needs", max_rounds: int | None = None) -> DataFrame:
    """calls: conv_id, call_id, turn, name, arguments; results: conv_id, call_id, turn, content.

    Returns conv_id, call_id, status, name, step, depth, result_step, valid, cyclic, blocked, canonical, ordered by step within each conversation.
    Raises when the steps don't settle in max_rounds, if that is given.
    """
    key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = lambda *c: F.min(F.struct(*c)).alias("f")
    asked = calls.where(key).groupBy(*_NODE).agg(first("turn", "name", "arguments")).select(*_NODE, F.lit(True).alias("asked"), "f.turn", "f.name", "f.arguments")
    given = results.where(key).groupBy(*_NODE).agg(first("turn", "content")).select(*_NODE, F.lit(True).alias("given"), F.col("f.turn").alias("result_turn"))
    value = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(F.col("value")).rlike(TYPES["object"]), F.lit(False))
    linked = asked.join(given, list(_NODE), "full_outer").withColumn("value", value)
    linked = linked.withColumn("canonical", F.when(is_object, F.to_json("value"))).withColumn("valid", F.when(F.col("asked"), valid_arguments(F.col("name"), F.col("value"), schemas)))
    linked = linked.withColumn("needs", F.try_variant_get("value", f"$.{needs_field}", "array<string>")).drop("value")
    status = F.when(F.col("asked").isNull(), "orphan").when(F.col("given").isNull(), "unanswered").otherwise("linked")
    nodes = materialize(linked.withColumn("status", status).select(*_NODE, "status", "name", "turn", "result_turn", "valid", "canonical", "needs"), "calls")

    asking = nodes.where("status <> 'orphan'").withColumn("turn", F.col("turn").cast("long")).withColumn("result_turn", F.col("result_turn").cast("long"))
    end = lambda name: [F.col("call_id").alias(name), F.col("turn").alias(f"{name}_turn"), F.col("result_turn").alias(f"{name}_result")]
    wanted = materialize(asking.select("conv_id", *end("dst"), F.explode(F.array_distinct("needs")).alias("src")).where("src is not null"), "needs")
    known = materialize(asking.select("conv_id", *end("src"), F.lit(True).alias("known")), "asked")
    edges = materialize(join_hot(wanted, known, "conv_id", "src"), "edges")
    unknown = edges.where("known is null").select("conv_id", F.col("dst").alias("call_id")).distinct().withColumn("lost", F.lit(True))
    edges = edges.where("known")
    # where every need is of an earlier turn and its result there by the call's turn, turns are the order
    out_of_order = ~F.coalesce(F.col("src_turn") < F.col("dst_turn"), F.lit(False)) | F.coalesce(F.col("src_result") > F.col("dst_turn"), F.lit(False))
    restless = materialize(edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(out_of_order).alias("restless")).where("restless"), "restless")
    solved = _solve(edges.join(restless.where(F.col("n") <= SHORT).select("conv_id"), "conv_id", "left_semi"))
    long = restless.where(F.col("n") > SHORT).select("conv_id")
    if not long.isEmpty():
        mine = materialize(edges.join(long, "conv_id", "left_semi"), "long")
        solved = solved.unionByName(_solve_long(asking.join(long, "conv_id", "left_semi"), mine, max_rounds))
    ordered = asking.select(*_NODE, F.col("turn").alias("step")).join(solved.withColumnRenamed("step", "later"), list(_NODE), "left").withColumn("step", F.coalesce("later", "step")).drop("later")
    out = nodes.join(ordered, list(_NODE), "left").join(unknown, list(_NODE), "left")
    out = out.select(
        *_NODE, "status", "name",
        F.coalesce("step", "result_turn").alias("step"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
        F.when(F.col("result_turn").isNotNull(), F.greatest("result_turn", F.coalesce("step", "result_turn"))).alias("result_step"),
        F.when(F.col("valid").isNotNull(), F.col("valid") & F.col("lost").isNull()).alias("valid"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        "canonical",
    )
    return out.orderBy("conv_id", "step", "depth", "call_id")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of (conv_id, turn, role, text) rows, which hold no tool calls of their own: stand-ins drawn from the turns and the
    lengths of their texts (those under 8 count as 11), a row at a time, so that logs are out of order, repeat, break their schemas and run in cycles.

    A user's turn calls ``reply``, needing the exchange before its own (unless its length divides by 3) and the one after (if
    the remainder by 4 is 1); its turn is a string if the length divides by 5, and a field is unknown if by 7. An assistant's turn is the result of the
    call one turn earlier; it repeats that call if its length divides by 6, and calls ``search``, needing it, if the remainder by 4 is 2.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.col("role").cast("string")).alias("role"), F.col("text").cast("string").alias("text"))
    name = lambda n: F.concat(F.lit("call_"), n.cast("string"))
    turn, n = F.col("turn"), F.when(F.length("text") >= 8, F.length("text")).otherwise(11)
    needs = F.array_compact(F.array(F.when((turn >= 2) & (n % 3 != 0), name(turn - 2)), F.when(n % 4 == 1, name(turn + 2))))
    own = [F.col("text").alias("question"), F.when(F.size(needs) > 0, needs).alias("needs"), F.when(n % 7 == 0, F.lit(True)).alias("extra")]
    arguments = F.when(n % 5 == 0, F.to_json(F.struct(turn.cast("string").alias("turn"), *own))).otherwise(F.to_json(F.struct(turn.alias("turn"), *own)))
    user, assistant = rows.where("role = 'user'"), rows.where("role = 'assistant'")
    calls = user.select("conv_id", name(turn).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"))
    again = assistant.where(n % 6 == 0).select("conv_id", name(turn - 1).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct("turn", F.col("text").alias("question"))).alias("arguments"))
    query = F.to_json(F.struct(F.col("text").alias("query"), F.array(name(turn - 1)).alias("needs")))
    search = assistant.where(n % 4 == 2).select("conv_id", F.concat(F.lit("find_"), turn.cast("string")).alias("call_id"), "turn", F.lit("search").alias("name"), query.alias("arguments"))
    results = assistant.select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls.unionByName(again).unionByName(search), results


def link_conversations(turns: DataFrame) -> DataFrame:
    """Tool-call linking of a table of conversations."""
    return link(*conversation_calls(turns), CHAT_SCHEMA)
