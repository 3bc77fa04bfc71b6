"""Linking tool calls to their results.

Calls and results are hash-joined by conversation and identifier, calls are
ordered so that each follows the calls it depends on, their arguments are
validated against schemas, and each becomes one canonical JSON record: keys in
ascending order, no white space.

Where every dependency stands before its call, the order of position is a
topological order already.  In the other conversations a call's level is the longest
chain of calls that it waits for; calls on a cycle, or behind one, have none and are
ordered last.  A conversation of up to ``ARRAY_CALLS`` calls becomes an array of
calls, and its levels are filled in passes over that array, in one job however deep
the chains are (time grows with the square of its calls if they all form one chain).  Larger ones go through rounds of joins, a level each, so that no
task holds such a conversation.

Only DataFrame functions are used.

Cases: a call or result with a null conversation or identifier links to nothing, so
dependencies within a null conversation don't count, and its calls, ordered as one
conversation, follow their positions; of several results for one call the
first in position counts, of several calls with one identifier all get it;
arguments that aren't a JSON object are invalid and become null; a name without a
schema is invalid; a dependency on an unknown call is dropped; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import written

ARRAY_CALLS = 10_000

# The variant type names that a schema's types stand for.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether parsed arguments (a variant) fit the schema of ``name``: tool -> field -> (type, required)."""
    verdict = F.lit(False)
    keys = F.json_object_keys(F.to_json(arguments))
    for tool, fields in schemas.items():
        fits = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>"))) == 0
        for field, (kind, required) in fields.items():
            present = F.array_contains(keys, field)
            found = F.regexp_extract(F.schema_of_variant(F.try_variant_get(arguments, f"$['{field}']", "variant")), "^[A-Z]+", 0)
            fits &= F.when(present, found.isin(*TYPES[kind])).otherwise(F.lit(not required))
        verdict = F.when(name == tool, fits).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def _array_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, key, level) as :func:`_levels` gives them, over one array of calls for each conversation."""
    numbered = calls.withColumn("ix", F.row_number().over(W.partitionBy("conv_id").orderBy("key")) - 1)
    of_needed = numbered.select("conv_id", F.col("key").alias("needs"), F.col("ix").alias("needed"))
    waits = needs.join(of_needed, ["conv_id", "needs"]).groupBy("conv_id", "key").agg(F.collect_list("needed").alias("waits"))
    listed = numbered.join(waits, ["conv_id", "key"], "left").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ix", "key", F.coalesce("waits", F.array().cast("array<int>")).alias("waits")))).alias("calls")
    )

    def fill(acc: Column, level: Column) -> Column:
        """One pass: calls whose needs have levels get this one; after a pass that changes nothing the rest are skipped."""
        ready = lambda c: F.forall(c["waits"], lambda w: F.get(acc["levels"], w).isNotNull())
        filled = F.transform(F.col("calls"), lambda c: F.coalesce(F.get(acc["levels"], c["ix"]), F.when(ready(c), level)))
        now = F.struct(filled.alias("levels"), (F.size(F.filter(filled, lambda x: x.isNotNull())) == F.size(F.filter(acc["levels"], lambda x: x.isNotNull()))).alias("done"))
        return F.when(acc["done"], acc).otherwise(now)

    start = F.struct(F.transform("calls", lambda c: F.lit(None).cast("int")).alias("levels"), F.lit(False).alias("done"))
    levels = F.aggregate(F.sequence(F.lit(0), F.size("calls")), start, fill, lambda acc: acc["levels"])
    each = listed.select("conv_id", F.explode(F.arrays_zip(F.col("calls.key").alias("key"), levels.alias("level"))).alias("z"))
    return each.select("conv_id", "z.key", "z.level").filter("level is not null")


def _levels(calls: DataFrame, needs: DataFrame, max_rounds: int | None) -> DataFrame:
    """(conv_id, key, level) of the calls that rounds can place: those in no cycle and behind none."""
    placed = written(calls.join(needs, ["conv_id", "key"], "left_anti").withColumn("level", F.lit(0)), "tool-levels")
    left, level = needs, 0
    while True:
        level += 1
        done = placed.select("conv_id", F.col("key").alias("needs"))
        left = written(left.join(done, ["conv_id", "needs"], "left_anti"), "tool-left")
        waiting = calls.join(placed, ["conv_id", "key"], "left_anti")
        ready = written(waiting.join(left, ["conv_id", "key"], "left_anti").withColumn("level", F.lit(level)), "tool-ready")
        if ready.isEmpty():
            return placed
        if level == max_rounds:
            raise RuntimeError(f"calls did not settle within {max_rounds} rounds")
        placed = placed.unionByName(ready)
        if level % 32 == 0:  # keeps the plan short
            placed = written(placed, "tool-levels")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], max_rounds: int | None = None) -> DataFrame:
    """One row per call: conv_id, call_id, position, topo_order, n_results, linked, valid, cyclic, record.

    ``calls``: conv_id, position, call_id, name, arguments (JSON text), depends_on
    (array of call_id, may be null).  ``results``: conv_id, position, call_id,
    content.  Chains may be of any depth; more rounds than ``max_rounds``, if given,
    are an error.
    """
    calls = calls.select("conv_id", "position", "call_id", "name", "arguments", "depends_on")
    answers = (
        results.filter("call_id is not null")
        .groupBy("conv_id", "call_id")
        .agg(F.min_by("content", F.struct("position", "content")).alias("result"), F.count("*").alias("n_results"))
    )
    own = F.struct("position", "name", "arguments")
    needs = calls.select("conv_id", "call_id", "position", F.explode("depends_on").alias("needs")).join(
        calls.groupBy("conv_id", F.col("call_id").alias("needs")).agg(F.min("position").alias("needed_at")), ["conv_id", "needs"]
    )
    late = needs.filter("needed_at >= position").select("conv_id").distinct()
    linked = calls.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    order = W.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "position", "call_id", "name", "arguments")
    if late.isEmpty():
        levelled = linked.withColumn("level", F.lit(0))
    else:
        # Null identifiers have a key too, so that such calls are placed.
        key_of = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))
        odd = written(calls.join(late, "conv_id", "left_semi").select("conv_id", key_of("call_id").alias("key")).distinct(), "tool-odd")
        needed = needs.join(late, "conv_id", "left_semi").select("conv_id", key_of("call_id").alias("key"), key_of("needs").alias("needs")).distinct()
        size = odd.groupBy("conv_id").agg(F.count("*").alias("n"))
        large = written(size.filter(F.col("n") > ARRAY_CALLS).select("conv_id"), "tool-large")
        levels = _array_levels(odd.join(large, "conv_id", "left_anti"), needed.join(large, "conv_id", "left_anti"))
        if not large.isEmpty():
            levels = levels.unionByName(_levels(odd.join(large, "conv_id", "left_semi"), written(needed.join(large, "conv_id", "left_semi"), "tool-needs"), max_rounds))
        marked = linked.join(late.withColumn("odd", F.lit(True)), "conv_id", "left").withColumn("key", key_of("call_id")).join(levels, ["conv_id", "key"], "left")
        levelled = marked.withColumn("level", F.when(F.col("odd"), F.col("level")).otherwise(F.lit(0))).drop("odd", "key")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    shaped = (
        levelled.withColumn("own", own)
        .withColumn("topo_order", F.row_number().over(order).cast("long"))
        .withColumn("n_results", F.coalesce("n_results", F.lit(0)))
        .withColumn("linked", F.col("n_results") > 0)
        .withColumn("parsed", F.when(is_object, parsed))
        .withColumn("valid", valid_arguments(F.col("name"), F.col("parsed"), schemas))
        .withColumn("cyclic", F.col("level").isNull())
    )
    record = F.to_json(
        F.struct(F.col("parsed").alias("arguments"), "call_id", "name", "result", F.col("topo_order").alias("turn"), "valid"), {"ignoreNullFields": "false"}
    )
    return shaped.withColumn("record", record).select("conv_id", "call_id", "position", "topo_order", "n_results", "linked", "valid", "cyclic", "record")


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results.

    A user turn is a call of the tool ``reply``; its identifier is the turn, and its
    arguments are ``text`` and ``size``, its code points, as a number or, in a text of
    several lines, as text.  It depends on the user turn before it or, if its size is
    even, on the one after it.  Other turns answer the latest user turn before them;
    those before the first answer nothing.
    """
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("asked", F.when(F.col("role") == "user", F.col("turn").cast("string")))
    turns = turns.withColumn("latest", F.last("asked", ignorenulls=True).over(w))
    asks = turns.filter("role = 'user'").withColumn("size", F.length(F.coalesce("text", F.lit("")))).withColumn("before", F.lag("asked").over(w)).withColumn("after", F.lead("asked").over(w))
    other = F.when(F.col("size") % 2 == 0, F.col("after")).otherwise(F.col("before"))
    lines = F.contains("text", F.lit("\n"))
    calls = asks.select(
        "conv_id",
        F.col("turn").alias("position"),
        F.col("asked").alias("call_id"),
        F.lit("reply").alias("name"),
        F.when(lines, F.to_json(F.struct("text", F.col("size").cast("string").alias("size")))).otherwise(F.to_json(F.struct("text", "size"))).alias("arguments"),
        F.when(other.isNotNull() & (other != F.col("asked")), F.array(other)).alias("depends_on"),
    )
    results = turns.filter("role is distinct from 'user'").select("conv_id", F.col("turn").alias("position"), F.col("latest").alias("call_id"), F.col("text").alias("content"))
    return calls, results
