"""Tool calls of conversations: linked with their results, ordered, checked and written as canonical JSON.

DataFrame operations only. Calls meet results through an equi-join on (conversation, call id)
after both sides are reduced to one row per id, so repeated results cannot pile up. The
topological order is found in rounds, each settling the calls whose needs are settled; only
open edges are carried along, written to the shared folder every round. Arguments are parsed
as variants, whose JSON form has sorted keys and no spaces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.ordering import running
from quillspark.session import materialize



@dataclass(frozen=True)
class Field:
    """What a schema says about one field: its type, and further bounds where they are given."""

    kind: str
    required: bool = False
    #: Allowed values, as they are written in JSON without quotes.
    values: Sequence[str] = ()
    least: float | None = None
    most: float | None = None
    #: Type of the items of an array.
    items: str | None = None
    #: Fields of an object; others in it are errors.
    fields: Mapping[str, "Field"] = field(default_factory=dict)


#: Per tool its fields.
Schemas = Mapping[str, Mapping[str, Field]]
#: Variant types that satisfy a schema type. Numbers without a fraction are integers, however they are written.
TYPES = {
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "string": "^STRING$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*",
}
#: The field of the arguments that lists the calls a call needs.
NEEDS = "after"
KEY = ["conv_id", "call_id"]


def field_errors(path: str, rule: Field) -> list[Column]:
    """The errors of one field (null where it has none), then those of the fields in it."""
    value = F.try_variant_get("parsed", f"$.{path}", "variant")
    found = F.schema_of_variant(value)
    typed = found.isNotNull() & found.rlike(TYPES[rule.kind])
    missing = F.when(F.lit(rule.required) & found.isNull(), F.lit(f"missing:{path}"))
    errors = [F.coalesce(missing, F.when(~found.rlike(TYPES[rule.kind]), F.lit(f"type:{path}")))]
    if rule.values:
        errors.append(F.when(typed & ~F.try_variant_get("parsed", f"$.{path}", "string").isin(*rule.values), F.lit(f"value:{path}")))
    if rule.least is not None or rule.most is not None:
        number = F.try_variant_get("parsed", f"$.{path}", "double")
        outside = F.lit(False) if rule.least is None else number < rule.least
        outside = outside if rule.most is None else outside | (number > rule.most)
        errors.append(F.when(typed & outside, F.lit(f"range:{path}")))
    if rule.items:
        each = F.try_variant_get("parsed", f"$.{path}", "array<variant>")
        errors.append(F.when(typed & F.exists(each, lambda x: ~F.coalesce(F.schema_of_variant(x).rlike(TYPES[rule.items]), F.lit(False))), F.lit(f"items:{path}")))
    if rule.fields:
        keys = F.map_keys(F.try_variant_get("parsed", f"$.{path}", "map<string,variant>"))
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, rule.fields))))
        inner = F.array_compact(F.array(*[e for name, r in sorted(rule.fields.items()) for e in field_errors(f"{path}.{name}", r)]))
        unknown = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"unknown:{path}."), k))
        errors.append(F.when(typed & (F.size(F.concat(inner, unknown)) > 0), F.array_join(F.concat(inner, unknown), ",")))
    return errors


def argument_errors(schemas: Schemas) -> Column:
    """The errors of one call's arguments, in a fixed order."""
    checks = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        own = F.array_compact(F.array(*[e for name, rule in sorted(fields.items()) for e in field_errors(name, rule)]))
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys("arguments"), F.array(*map(F.lit, fields)))), lambda k: F.concat(F.lit("unknown:"), k))
        checks = F.when(F.col("tool") == tool, F.concat(own, extra)).otherwise(checks)
    shape = F.schema_of_variant("parsed")
    return (
        F.when(F.col("tool").isNull() | ~F.col("tool").isin(*schemas), F.array(F.lit("unknown_tool")))
        .when(shape.isNull() | ~shape.rlike("^OBJECT<"), F.array(F.lit("invalid_json"))).otherwise(checks)
    )


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without needs, else one more than the highest need.

    ``edges`` has ``conv_id, call_id, need``, both ends known. Calls on a cycle, or behind one,
    get no level. The number of rounds is the longest chain of needs.
    """
    settled = calls.join(edges, KEY, "left_anti").select(*KEY, F.lit(0).alias("level"))
    newly = settled = materialize(settled)
    open_ = edges.withColumn("reached", F.lit(None).cast("int"))
    while True:
        step = newly.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), "level")
        open_ = materialize(
            open_.join(step, (F.col("conv_id") == F.col("c")) & (F.col("need") == F.col("n")), "left")
            .select(*KEY, "need", F.coalesce("reached", "level").alias("reached"))
        )
        newly = materialize(
            open_.groupBy(*KEY).agg(F.count("*").alias("all"), F.count("reached").alias("known"), F.max("reached").alias("high"))
            .where("all = known").select(*KEY, (F.col("high") + 1).alias("level"))
        )
        if newly.isEmpty():
            return settled
        settled = settled.unionByName(newly)
        open_ = open_.join(newly, KEY, "left_anti")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls``: ``conv_id, call_id, turn, tool, arguments`` (JSON text). ``results``: ``conv_id,
    call_id, turn, content``. Returns ``conv_id, call_id, turn, tool, level, place, n_results,
    errors, message``: ``place`` counts a conversation's calls in topological order (then turn
    and id; calls on cycles last), ``errors`` is comma-separated, ``message`` canonical JSON.

    Calls that repeat an id are one call, the first by turn, tool and arguments. Calls or results
    without conversation or id cannot be linked: the calls have no results and level 0, the
    results are orphans. Null arguments are invalid JSON. A call needs those known calls of its
    conversation that its arguments list; unknown ones are an error. The first result by turn
    and content is the one linked. Empty tables give an empty result; other columns are not read.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    body = F.struct("turn", "tool", "arguments")
    calls = calls.select(*KEY, "turn", "tool", "arguments")
    once = calls.where(named).groupBy(*KEY).agg(F.min(body).alias("first")).select(*KEY, "first.*")
    every = once.unionByName(calls.where(~named)).withColumn("parsed", F.try_parse_json("arguments"))
    needs = F.when(F.schema_of_variant("parsed").rlike("^OBJECT<"), F.try_variant_get("parsed", f"$.{NEEDS}", "array<string>"))
    checked = materialize(every.select(*KEY, "turn", "tool", "arguments", argument_errors(schemas).alias("errors"), F.array_distinct(F.coalesce(needs, F.array())).alias("needs")))

    wanted = checked.where(named).select(*KEY, F.explode("needs").alias("need")).where("need IS NOT NULL")
    known = once.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_call"))
    matched = materialize(wanted.join(known, (F.col("conv_id") == F.col("k_conv")) & (F.col("need") == F.col("k_call")), "left"))
    edges = matched.where("k_call IS NOT NULL").select(*KEY, "need")
    unknown = matched.where("k_call IS NULL").groupBy(*KEY).agg(F.count("*").alias("unknown"))
    level = levels(checked.where(named).select(*KEY), edges)

    answers = results.where(named).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n"))
    joined = (
        checked.where(named).join(level, KEY, "left").join(unknown, KEY, "left").join(answers, KEY, "left")
        .unionByName(checked.where(~named).withColumn("level", F.lit(0)), allowMissingColumns=True)
    )
    errors = F.concat(
        "errors", F.when(F.col("unknown") > 0, F.array(F.lit("unknown_need"))).otherwise(F.array()),
        F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array()),
        F.when(F.col("n").isNull(), F.array(F.lit("no_result"))).otherwise(F.array()),
    )
    # Places are found on narrow rows; arguments and results join once, by the row's number.
    linked = materialize(joined.select(
        F.monotonically_increasing_id().alias("row"), *KEY, "turn", "tool", "level", "arguments", F.coalesce("n", F.lit(0)).alias("n_results"), F.array_join(errors, ",").alias("errors"), F.col("answer.content").alias("content")
    ))
    narrow = linked.select("row", "conv_id", "level", "turn", "call_id", F.xxhash64("tool", "arguments").alias("tie"))
    order = running(narrow, ["conv_id"], [F.col("level").isNull(), F.col("level"), F.col("turn"), F.col("call_id"), "tie", "row"], rank="place")
    placed = linked.join(order.select("row", "place"), "row")
    message = F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("tool").alias("name"), F.col("place"), F.col("content").alias("result"),
    ))
    columns = [*KEY, "turn", "tool", "level", "place", "n_results", "errors"]
    given = once.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_call"))
    orphans = results.join(given, (F.col("conv_id") == F.col("k_conv")) & (F.col("call_id") == F.col("k_call")), "left_anti")
    lost = orphans.select(
        *KEY, "turn", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place"), F.lit(0).cast("long").alias("n_results"),
        F.lit("orphan_result").alias("errors"), F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("message"),
    )
    return placed.select(*columns, message.alias("message")).unionByName(lost)


# The given conversations as tool traffic -------------------------------------------------

NEEDED = {NEEDS: Field("array")}
SCHEMAS: Schemas = {
    "search": {"query": Field("string", True), "limit": Field("integer", True), **NEEDED},
    "lookup": {"query": Field("string", True), "limit": Field("integer"), **NEEDED},
    "score": {"query": Field("string"), "limit": Field("number", True), **NEEDED},
}
#: Expressions both engines read alike: assistant turns are calls, user turns answer the turn before.
#: Whole texts are the queries and the results. Lengths plant wrong types, missing and unknown fields, cut JSON, unknown tools, cycles and lost ids.
CALL_ID = "concat('call_', CAST(turn AS VARCHAR(20)))"
TOOL = "CASE WHEN length(text) % 29 = 0 THEN 'paint' WHEN turn % 3 = 0 THEN 'search' WHEN turn % 3 = 1 THEN 'lookup' ELSE 'score' END"
LIMIT = "CASE WHEN length(text) % 11 = 0 THEN '\"many\"' ELSE CAST(length(text) % 20 + 1 AS VARCHAR(20)) END"
AFTER = (
    "concat('\"call_', CAST((turn - turn % 2) / 2 AS {int}), '\"', "
    "CASE WHEN turn < 6 AND length(text) % 5 = 0 THEN concat(', \"call_', CAST(turn + 2 AS VARCHAR(20)), '\"') ELSE '' END)"
)
#: The whole text, escaped as the inside of a JSON string, in either engine.
QUERY = "substr(to_json(array(text)), 3, length(to_json(array(text))) - 4)"
QUERY_ORACLE = "substr(CAST(to_json(text) AS VARCHAR), 2, length(CAST(to_json(text) AS VARCHAR)) - 2)"


def arguments_sql(int_: str, query: str) -> str:
    return (
        f"concat('{{ ', CASE WHEN length(text) % 13 = 0 THEN '' ELSE concat('\"query\": \"', {query}, '\", ') END, "
        f"'\"limit\": ', {LIMIT}, CASE WHEN length(text) % 23 = 0 THEN ', \"extra\": null' ELSE '' END, "
        f"', \"{NEEDS}\": [', {AFTER.format(int=int_)}, ']', CASE WHEN length(text) % 17 = 0 THEN '' ELSE ' }}' END)"
    )


def calls_of(conversations: DataFrame) -> DataFrame:
    return conversations.where("role = 'assistant'").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", f"{CALL_ID} AS call_id", "CAST(turn AS BIGINT) AS turn", f"{TOOL} AS tool", f"{arguments_sql('INT', QUERY)} AS arguments"
    )


def results_of(conversations: DataFrame) -> DataFrame:
    answers = conversations.where("role = 'user' AND turn > 0").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "text AS content",
        "concat(concat('call_', CAST(turn - 1 AS VARCHAR(20))), CASE WHEN length(text) % 7 = 0 THEN 'x' ELSE '' END) AS call_id",
        "CASE WHEN length(text) % 19 = 0 THEN 2 ELSE 1 END AS times",
    )
    return answers.select("conv_id", "call_id", "turn", "content", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


ORACLE = f"""
    WITH RECURSIVE calls AS (
        SELECT CAST(conv_id AS BIGINT) AS conv_id, {CALL_ID} AS call_id, CAST(turn AS BIGINT) AS turn, {TOOL} AS tool,
               {arguments_sql('INTEGER', QUERY_ORACLE)} AS arguments
        FROM conversations WHERE role = 'assistant'
    ), results AS (
        SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, text AS content,
               concat('call_', CAST(turn - 1 AS VARCHAR), CASE WHEN length(text) % 7 = 0 THEN 'x' ELSE '' END) AS call_id
        FROM conversations, range(2) AS again(k) WHERE role = 'user' AND turn > 0 AND (k = 0 OR length(text) % 19 = 0)
    ), parsed AS (
        SELECT *, CASE WHEN json_valid(arguments) THEN arguments END AS j FROM calls
    ), typed AS (
        SELECT *, json_type(j, '$.query') AS tq, json_type(j, '$.limit') AS tl, json_type(j, '$.{NEEDS}') AS ta,
               list_sort(list_filter(json_keys(j), lambda k: k NOT IN ('query', 'limit', '{NEEDS}'))) AS extra,
               from_json(json_extract(j, '$.{NEEDS}'), '["VARCHAR"]') AS needs
        FROM parsed
    ), wanted AS (
        SELECT DISTINCT conv_id, call_id, unnest(needs) AS need FROM typed
    ), edges AS (
        SELECT w.* FROM wanted w WHERE EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = w.conv_id AND c.call_id = w.need)
    ), paths AS (
        SELECT conv_id, call_id, call_id AS tip, 0 AS depth FROM calls
        UNION SELECT p.conv_id, p.call_id, e.need, p.depth + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.call_id = p.tip WHERE p.depth < 12
    ), level AS (
        SELECT conv_id, call_id, CASE WHEN max(depth) < 12 THEN max(depth) END AS level FROM paths GROUP BY ALL
    ), answers AS (
        SELECT conv_id, call_id, count(*) AS n, min((turn, content)) AS answer FROM results GROUP BY ALL
    ), checked AS (
        SELECT t.*, l.level, coalesce(a.n, 0) AS n_results, a.answer[2] AS content, list_filter([
            CASE WHEN tool = 'paint' THEN 'unknown_tool' WHEN j IS NULL THEN 'invalid_json' END,
            CASE WHEN tool <> 'paint' AND j IS NOT NULL AND ta <> 'ARRAY' THEN 'type:{NEEDS}' END,
            CASE WHEN tool <> 'paint' AND j IS NOT NULL THEN CASE WHEN tl IS NULL AND tool <> 'lookup' THEN 'missing:limit' WHEN tl NOT IN ('UBIGINT', 'BIGINT') THEN 'type:limit' END END,
            CASE WHEN tool <> 'paint' AND j IS NOT NULL THEN CASE WHEN tq IS NULL AND tool <> 'score' THEN 'missing:query' WHEN tq <> 'VARCHAR' THEN 'type:query' END END,
            CASE WHEN tool <> 'paint' AND len(extra) > 0 THEN concat('unknown:', array_to_string(extra, ',unknown:')) END,
            CASE WHEN EXISTS (SELECT 1 FROM wanted w WHERE w.conv_id = t.conv_id AND w.call_id = t.call_id
                AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = w.conv_id AND c.call_id = w.need)) THEN 'unknown_need' END,
            CASE WHEN l.level IS NULL THEN 'cycle' END, CASE WHEN a.n IS NULL THEN 'no_result' END], lambda e: e IS NOT NULL) AS errors
        FROM typed t JOIN level l ON l.conv_id = t.conv_id AND l.call_id = t.call_id
        LEFT JOIN answers a ON a.conv_id = t.conv_id AND a.call_id = t.call_id
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) AS place FROM checked
    )
    SELECT conv_id, call_id, turn, tool, CAST(level AS INTEGER) AS level, place, n_results, array_to_string(errors, ',') AS errors,
           concat('{{', concat_ws(',',
               CASE WHEN j IS NOT NULL THEN concat('"arguments":{{', concat_ws(',', concat('"{NEEDS}":["', array_to_string(needs, '","'), '"]'),
                   CASE WHEN len(extra) > 0 THEN '"extra":null' END, concat('"limit":', json_extract(j, '$.limit')),
                   CASE WHEN tq IS NOT NULL THEN concat('"query":', json_extract(j, '$.query')) END), '}}') END,
               concat('"id":"', call_id, '"'), CASE WHEN level IS NOT NULL THEN concat('"level":', level) END, concat('"name":"', tool, '"'),
               concat('"place":', place), CASE WHEN content IS NOT NULL THEN concat('"result":', CAST(to_json(content) AS VARCHAR)) END), '}}') AS message
    FROM placed
    UNION ALL
    SELECT conv_id, call_id, turn, NULL, NULL, NULL, 0, 'orphan_result', concat('{{"id":"', call_id, '","result":', CAST(to_json(content) AS VARCHAR), '}}')
    FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
