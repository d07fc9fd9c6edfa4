"""Tool calls and their results: linked, ordered, validated and serialised, with DataFrame functions only.

Calls and results meet in a hash join on conversation and call identifier. Calls are ordered so that each
comes after the calls it depends on. Arguments are checked against the schema of the tool, and every call
becomes one canonical JSON text: keys sorted, no spaces, so that equal calls are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import numbered
from pagelens.session import materialize

#: Arguments of each tool: name, variant type, whether it must be there.
SCHEMAS = {
    "reply": (("question", "string", True), ("turn", "bigint", True), ("words", "bigint", True)),
    "advise": (("question", "string", True), ("turn", "bigint", True), ("words", "bigint", True), ("system", "string", False)),
}
CALL = "struct<turn: bigint, name: string, arguments: string, depends: array<string>>"


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each ``conv_id, call_id`` of ``calls`` (turn, name, arguments, depends) and ``results`` (turn, content).

    Of rows that repeat an identifier the first by turn and content counts and the others are only counted,
    before the join, so that repeats never multiply. ``status`` is linked, unanswered (no result), orphan (no
    call) or early (the result comes before its call). A null conversation is a conversation; rows with a
    null identifier can't be linked and stay single: calls are unanswered and results orphans.
    """
    keys = ["conv_id", "call_id"]
    tell = lambda d, parts: d.withColumn("_single", F.when(F.col("call_id").isNull(), F.xxhash64(*parts)))
    c = tell(calls, ["turn", "name", "arguments"]).groupBy(*keys, "_single").agg(
        F.min(F.struct("turn", "name", "arguments", "depends")).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    r = tell(results, ["turn", "content"]).groupBy(*keys, "_single").agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results"))
    r = r.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "result", "n_results")
    j = c.join(r, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "full_outer")
    status = (F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered")
              .when(F.col("result.turn") < F.col("call.turn"), "early").otherwise("linked"))
    mine = F.col("call").isNotNull()
    return j.select(F.when(mine, F.col("conv_id")).otherwise(F.col("_c")).alias("conv_id"), F.when(mine, F.col("call_id")).otherwise(F.col("_i")).alias("call_id"),
                    "call", "result", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"))


def layered(links: DataFrame) -> DataFrame:
    """``links`` with ``layer``, so that (layer, turn, call_id) is a topological order of each conversation.

    Where every call already follows what it depends on by turn, turns are such an order and the layer is 0.
    Only conversations with a call that doesn't are peeled: a round gives the next layer to all calls whose
    dependencies have one. Calls on a cycle, and those behind it, get layer -1. A dependency on a call that
    isn't there binds nothing.
    """
    named = links.filter("call IS NOT NULL AND call_id IS NOT NULL")
    edges = named.select("conv_id", "call_id", F.col("call.turn").alias("turn"), F.explode(F.array_distinct("call.depends")).alias("on_id"))
    there = named.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("call.turn").alias("_t"))
    edges = materialize(edges.join(there, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("on_id") == F.col("_i"))).drop("_c", "_i"), "depends")
    crossed = edges.filter("NOT coalesce(turn, 0) > coalesce(_t, 0)").select("conv_id").distinct()
    if crossed.isEmpty():
        return links.withColumn("layer", F.lit(0))
    crossed = materialize(crossed.withColumnRenamed("conv_id", "_c"), "crossed")
    within = F.col("conv_id").eqNullSafe(F.col("_c"))
    left = materialize(edges.join(crossed, within, "left_semi").select("conv_id", "call_id", "on_id"), "open")
    waiting = left.select("conv_id", "call_id").distinct()
    open_calls = named.join(crossed, within, "left_semi").select("conv_id", "call_id")
    both = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["call_id"] == b["call_id"])
    free = materialize(open_calls.join(waiting, both(open_calls, waiting), "left_anti").withColumn("layer", F.lit(0)), "layer")
    done, layer = free, 0
    while not free.isEmpty():
        layer += 1
        gone = free.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"))
        rest = materialize(left.join(gone, within & (F.col("on_id") == F.col("_i")), "left_anti"), "open")
        before, still = left.select("conv_id", "call_id").distinct(), rest.select("conv_id", "call_id").distinct()
        free = materialize(before.join(still, both(before, still), "left_anti").withColumn("layer", F.lit(layer)), "layer")
        done, left = done.unionByName(free), rest
    found = done.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "layer")
    peeled = links.join(found, within & (F.col("call_id") == F.col("_i")), "left").drop("_c", "_i")
    return peeled.join(crossed.withColumn("_x", F.lit(True)), within, "left").withColumn(
        "layer", F.coalesce("layer", F.when(F.col("_x") & F.col("call").isNotNull(), -1).otherwise(0))).drop("_c", "_x")


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with the arguments of a call, sorted; empty for a valid call."""
    parsed = F.try_parse_json(arguments)
    known, cases = F.array(*[F.lit(n) for n in sorted(schemas)]), F.array().cast("array<string>")
    for tool, fields in schemas.items():
        checks = [F.when(F.try_variant_get(parsed, f"$.{field}", kind).isNull() & (F.try_variant_get(parsed, f"$.{field}", "string").isNotNull() | F.lit(must)),
                         F.lit(f"{field}: no {kind}")) for field, kind, must in fields]
        extra = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f, _, _ in fields])), lambda k: F.concat(k, F.lit(": unknown")))
        cases = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>")))).otherwise(cases)
    return (F.when(F.coalesce(F.schema_of_variant(parsed), F.lit("")).startswith("OBJECT"), F.when(F.array_contains(known, name), F.array_sort(cases)).otherwise(F.array(F.lit("unknown tool"))))
            .otherwise(F.array(F.lit("no object"))))


def canonical(value: Column) -> Column:
    """Canonical form of a JSON text: a variant keeps its keys sorted and prints without spaces; null where it is no JSON."""
    return F.to_json(F.try_parse_json(value))


def tool_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``conv_id, call_id, position, layer, status, n_calls, n_results, valid, problems, json`` of every call and orphan result.

    ``position`` counts from 1 in each conversation, in topological order with orphans by their own turn. It
    comes from one range sort of all rows, so that a conversation of any length is no single task.
    """
    rows = layered(materialize(linked(calls, results), "links"))
    turn = F.coalesce(F.col("call.turn"), F.col("result.turn"))
    wrong = F.when(F.col("call").isNotNull(), problems(F.col("call.name"), F.col("call.arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    text = F.to_json(F.struct(
        F.coalesce(F.try_parse_json("call.arguments"), F.try_parse_json(F.to_json(F.struct(F.col("call.arguments").alias("text"))))).alias("arguments"),
        F.col("call_id").alias("id"), F.col("call.name").alias("name"), F.col("result.content").alias("result")))
    rows = rows.select("conv_id", "call_id", "layer", turn.alias("_turn"), "status", "n_calls", "n_results", F.concat_ws("; ", wrong).alias("problems"), text.alias("json"))
    order = [F.col("conv_id"), F.when(F.col("layer") < 0, F.lit(1 << 30)).otherwise(F.col("layer")), F.col("_turn"), F.col("call_id"), F.col("json")]
    rows = materialize(numbered(rows, order, "_at"), "numbered")
    first = rows.groupBy("conv_id").agg(F.min("_at").alias("_first")).withColumnRenamed("conv_id", "_c")
    j = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")))
    return j.select("conv_id", "call_id", (F.col("_at") - F.col("_first") + 1).alias("position"), "layer", "status", "n_calls", "n_results",
                    ((F.col("problems") == "") & (F.col("n_calls") > 0)).alias("valid"), "problems", "json")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user turn asks for a reply, which depends on the user turn before it; the assistant turn that follows is the result.

    Identifiers come from turn numbers alone, so no conversation has to be gathered. The call of turn 1 is
    to ``advise``, as turn 0 may be the system's.
    """
    ident = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id"), t)
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    arguments = F.to_json(F.struct(text.alias("question"), turn.alias("turn"), words.alias("words")))
    asked = conversations.filter("role = 'user'").select(
        "conv_id", ident(turn).alias("call_id"), turn.alias("turn"), F.when(turn == 1, "advise").otherwise("reply").alias("name"),
        arguments.alias("arguments"), F.array(ident(turn - 2)).alias("depends"))
    answered = conversations.filter("role = 'assistant'").select("conv_id", ident(turn - 1).alias("call_id"), turn.alias("turn"), text.alias("content"))
    return asked, answered


def conversation_calls(conversations: DataFrame) -> DataFrame:
    return tool_calls(*turns_as_calls(conversations))


ORACLE = r"""
WITH c AS (SELECT conv_id, concat_ws('-', 'call', conv_id, turn) AS call_id, turn, CASE turn WHEN 1 THEN 'advise' ELSE 'reply' END AS name, coalesce(text, '') AS q,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id, turn) AS n
  FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY q) = 1),
r AS (SELECT conv_id, concat_ws('-', 'call', conv_id, turn - 1) AS call_id, turn AS back, coalesce(text, '') AS a, count(*) OVER (PARTITION BY conv_id, turn) AS m
  FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY a) = 1),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(turn, back) AS spot, coalesce(n, 0) AS n_calls, coalesce(m, 0) AS n_results,
    CASE WHEN name IS NULL THEN 'orphan' WHEN back IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    concat('{"arguments":', CASE WHEN name IS NULL THEN '{}' ELSE json_object('question', q, 'turn', turn, 'words', words)::VARCHAR END, ',"id":', to_json(coalesce(c.call_id, r.call_id))::VARCHAR,
      CASE WHEN name IS NULL THEN '' ELSE ',"name":' || to_json(name)::VARCHAR END, CASE WHEN back IS NULL THEN '' ELSE ',"result":' || to_json(a)::VARCHAR END, '}') AS json
  FROM c FULL JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot, call_id, json) AS position, 0 AS layer, status, n_calls, n_results, n_calls > 0 AS valid, '' AS problems, json FROM j
"""
