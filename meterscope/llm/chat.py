"""Chat formatting: link tool calls with their results, order them, validate and serialise them.

Calls and results meet in a hash join on their identifier. Calls are ordered topologically by what they
depend on. Conversations of up to GROUP calls, none of which depends on another conversation's, are ordered in
one pass over the calls sorted by conversation. What is left, long conversations and those that lean on
others, is ordered by joins: in a round, calls whose dependencies are done are done, and every edge to a
call with one dependency is led on to that dependency, so a chain takes as many rounds as its length has bits.
Arguments are parsed, checked against the tool's schema and written as canonical JSON: keys sorted, no
white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, settled, table

#: tool: {argument: (type, required)}; types as variants have them. What the query's calls are held to.
SCHEMAS = {
    "configure": {"text": ("STRING", True), "turn": ("BIGINT", True)},
    "reply": {"text": ("STRING", True), "turn": ("BIGINT", True)},
}
#: Calls that a conversation may have to be ordered in one task.
GROUP = 20_000
#: Turns, or levels, that are counted together before those of a conversation are added up.
STRETCH = 1024


def with_argument_errors(rows: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """rows(name, arguments, ...) with `errors`, a sorted array of what is wrong with the arguments (JSON
    text) of the tool `name`; empty: valid. `__parsed` stays, the arguments as a variant: each is parsed
    once and each field looked up once, in steps of their own."""
    fields = sorted({f for tool in schemas.values() for f in tool})
    rows = rows.withColumn("__parsed", F.try_parse_json("arguments"))
    got = [F.try_variant_get("__parsed", f"$.{f}", "variant").alias(f"__f{i}") for i, f in enumerate(fields)]
    rows = rows.select("*", F.schema_of_variant("__parsed").alias("__kind"), F.json_object_keys("arguments").alias("__keys"), *got)
    rows = rows.select("*", *[F.coalesce(F.schema_of_variant(f"__f{i}"), F.lit("VOID")).alias(f"__t{i}") for i in range(len(fields))])
    parsed = F.col("__parsed").isNotNull()
    found = [F.when(~parsed, F.lit("arguments: not JSON")), F.when(parsed & ~F.col("__kind").startswith("OBJECT"), F.lit("arguments: not an object"))]
    known = F.lit(False)
    for tool, own_fields in schemas.items():
        own = F.col("name") == tool
        known = known | own
        for field, (type_, required) in own_fields.items():
            kind = F.col(f"__t{fields.index(field)}")
            if required:
                found.append(F.when(own & parsed & (kind == "VOID"), F.lit(f"{field}: missing")))
            found.append(F.when(own & (kind != "VOID") & (kind != type_), F.lit(f"{field}: not {type_}")))
        more = F.array_except("__keys", F.array(*[F.lit(f) for f in own_fields]))
        found.append(F.when(own & (F.size(more) > 0), F.concat(F.lit("unknown: "), F.array_join(F.array_sort(more), ","))))
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("name: no such tool")))
    rows = rows.withColumn("errors", F.array_sort(F.array_compact(F.array(*found))))
    return rows.drop("__kind", "__keys", *[f"__{x}{i}" for i in range(len(fields)) for x in "ft"])


def order(ids: list[str], after: list[list[str] | None]) -> tuple[list[int | None], list[list[str]]]:
    """(level of each call, dependencies that are not among ids): Kahn's algorithm on one conversation."""
    place = {c: i for i, c in enumerate(ids)}
    deps = [set(a or ()) for a in after]
    outside = [sorted(x for x in d if x is not None and x not in place) for d in deps]
    inner = [[place[x] for x in d if x in place] for d in deps]
    left, next_, level = [len(d) for d in inner], {}, [0] * len(ids)
    for i, d in enumerate(inner):
        for j in d:
            next_.setdefault(j, []).append(i)
    front = [i for i, n in enumerate(left) if not n]
    for i in front:  # grows while it is read
        for j in next_.get(i, ()):
            level[j] = max(level[j], level[i] + 1)
            left[j] -= 1
            if not left[j]:
                front.append(j)
    return [None if left[i] else level[i] for i in range(len(ids))], outside


def _order_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, call_id, after) come sorted by conv, with at most GROUP of one."""
    held: list[tuple] = []
    conv = None

    def flush() -> pa.RecordBatch:
        levels, outside = order([h[0] for h in held], [h[1] for h in held])
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(held), pa.string()), pa.array([h[0] for h in held], pa.string()), pa.array(levels, pa.int64()), pa.array(outside, pa.list_(pa.string()))], names=["conv", "call_id", "level", "outside"])

    for batch in batches:
        out = []
        for c, call, after in zip(*(batch.column(n).to_pylist() for n in ("conv", "call_id", "after")), strict=True):
            if c != conv:
                if held:
                    out.append(flush())
                held, conv = [], c
            held.append((call, after))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if held:
        yield flush()


def topological_levels(calls: DataFrame, group: int = GROUP) -> DataFrame:
    """(call_id, level) of calls(conv_id, call_id, after), one row a call_id: 0 without dependencies, else one
    more than the highest of them; null on or behind a cycle. Unknown calls in `after` are not counted."""
    rows = calls.select(F.col("conv_id").cast("string").alias("conv"), "call_id", F.array_compact(F.coalesce("after", F.array().cast("array<string>"))).alias("after"))
    large = materialize(rows.where("conv is not null").groupBy("conv").count().where(F.col("count") > group).select("conv"), "long-conversations")
    small = join_checked(rows.where("conv is not null"), large, "conv", "left_anti")
    passed = small.repartition("conv").sortWithinPartitions("conv").mapInArrow(_order_rows, "conv string, call_id string, level long, outside array<string>")
    passed = materialize(passed, "ordered")
    beyond = passed.select("conv", F.explode("outside").alias("call_id"))
    leaning = materialize(beyond.join(rows.select("call_id"), "call_id").select("conv").distinct(), "leaning")
    levels = passed.select("call_id", "level")
    if leaning.isEmpty() and large.isEmpty() and rows.where("conv is null").isEmpty():
        return levels
    closed = join_checked(passed, leaning, "conv", "left_anti").select("call_id", "level")
    open_ = join_checked(rows.where("conv is not null"), materialize(leaning.union(large), "open-conversations"), "conv", "left_semi").unionByName(rows.where("conv is null"))
    return closed.unionByName(_levels_of_open(open_, closed, rows))


def _levels_of_open(calls: DataFrame, closed: DataFrame, known: DataFrame) -> DataFrame:
    """(call_id, level) of calls(call_id, after), which may depend on each other and on the closed ones.

    An edge (call_id, dep, add) says that the call's level is at least the dep's plus add; floor is what done
    dependencies ask for. A round that ends no call leaves only calls on or behind cycles.
    """
    edges = calls.select("call_id", F.explode(F.array_distinct("after")).alias("dep"), F.lit(1).cast("long").alias("add"))
    edges = materialize(edges.join(known.select(F.col("call_id").alias("dep")), "dep", "left_semi"), "edges")
    state = materialize(calls.select("call_id", F.lit(0).cast("long").alias("floor")), "open")
    done = closed
    ended = []
    while True:
        fixed = done.select(F.col("call_id").alias("dep"), F.col("level").alias("at"), F.lit(True).alias("known"))
        met = edges.join(fixed, "dep", "left")
        # calls behind a closed cycle never end: their edges stay
        gone = F.col("known") & F.col("at").isNotNull()
        met = materialize(met.select("call_id", "dep", "add", F.when(gone, F.col("at") + F.col("add")).alias("floor"), F.coalesce(gone, F.lit(False)).alias("gone")), "met")
        raised = met.where("gone").groupBy("call_id").agg(F.max("floor").alias("raised"))
        counts = met.where("not gone").groupBy("call_id").agg(F.count("*").alias("left"), F.min("dep").alias("next"), F.min("add").alias("plus"))
        state = state.join(raised, "call_id", "left").join(counts, "call_id", "left").select("call_id", F.greatest("floor", F.coalesce("raised", F.lit(0))).alias("floor"), F.coalesce("left", F.lit(0)).alias("left"), "next", "plus")
        state = materialize(state, "open")
        done = materialize(state.where("left = 0").select("call_id", F.col("floor").alias("level")), "done")
        if done.isEmpty():
            rest = state.select("call_id", F.lit(None).cast("long").alias("level"))
            out = rest
            for part in ended:
                out = out.unionByName(part)
            return out
        ended.append(done)
        # edges to a call with one dependency are led on to it
        one = state.where("left = 1 and next <> call_id").select(F.col("call_id").alias("dep"), F.col("next"), F.col("plus"), F.col("floor").alias("least"))
        led = met.where("not gone").select("call_id", "dep", "add").join(one, "dep", "left")
        led = materialize(led.select("call_id", F.coalesce("next", "dep").alias("dep"), (F.col("add") + F.coalesce("plus", F.lit(0))).alias("add"), (F.col("least") + F.col("add")).alias("least")), "led")
        edges = materialize(led.groupBy("call_id", "dep").agg(F.max("add").alias("add")), "edges")
        floors = led.groupBy("call_id").agg(F.max("least").alias("raised"))
        state = materialize(state.where("left > 0").join(floors, "call_id", "left").select("call_id", F.greatest("floor", F.coalesce("raised", F.lit(0))).alias("floor")), "open")


def with_places(rows: DataFrame, key: str, coarse: Column, by: list) -> DataFrame:
    """rows with `place`, from 1, in the order of `coarse` (not null, of which `by` is a refinement) in each
    value of `key`: stretches of coarse values are counted first, so that a long conversation is several tasks' work."""
    rows = rows.withColumn("__coarse", coarse)
    per = rows.groupBy(key, "__coarse").count()
    before = F.sum("count").over(Window.partitionBy(key).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(F.col(key).alias("__k"), F.col("__coarse").alias("__c"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__coarse").orderBy(*by))
    rows = rows.withColumn("__inside", inside)
    rows = rows.join(per, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__coarse") == F.col("__c")))
    return rows.withColumn("place", F.col("__before") + F.col("__inside")).drop("__coarse", "__k", "__c", "__before", "__inside")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row a call: conv_id, call_id, name, level, place, n_results, valid, errors, record.

    calls(conv_id, call_id, turn, name, arguments, after array<string>), results(call_id, turn, content).
    Of rows that repeat a call_id the one with the least turn, name and arguments stays; of several
    results the first by turn and content is linked, n_results counts them; results without a call are
    left out; calls without a result have a null result. place counts a conversation's calls by level,
    turn and identifier, those in cycles last. Rows with null call_id are left out; calls with a null
    conv_id are one conversation. record is canonical JSON of arguments, id, name and result; arguments that do
    not parse stand there as text. Empty and long texts are whole in it; arguments beyond what a variant holds
    (128 MB) count as not JSON. Empty tables give no rows; other columns are not read.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after").where("call_id is not null")
    first = F.min(F.struct("turn", "name", "arguments", "after", "conv_id")).alias("c")
    calls = materialize(calls.groupBy("call_id").agg(first).select("call_id", "c.*"), "calls")
    results = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(F.col("turn").alias("turn"), "content")).alias("r"), F.count("*").alias("n_results"))
    level = settled(lambda: topological_levels(calls), "levels")
    placed = with_places(calls.select("call_id", "conv_id", "turn").join(level, "call_id"), "conv_id", F.coalesce(F.floor(F.col("level") / STRETCH), F.lit(1 << 62)), [F.col("level").asc_nulls_last(), "turn", "call_id"])
    rows = with_argument_errors(calls, schemas).join(placed.select("call_id", "level", "place"), "call_id").join(results.hint("shuffle_hash"), "call_id", "left")
    canonical = F.coalesce(F.to_json("__parsed"), F.to_json(F.struct(F.col("arguments").alias("text"))))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    text = lambda c: F.when(c.isNull(), "null").otherwise(quoted(c))
    record = F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("r.content")), F.lit("}"))
    errors = F.concat("errors", F.when(F.col("level").isNull(), F.array(F.lit("after: cycle"))).otherwise(F.array().cast("array<string>")))
    out = rows.select("conv_id", "call_id", "name", F.col("level").cast("int").alias("level"), "place", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), errors.alias("errors"), record.alias("record"))
    return out.withColumn("valid", F.size("errors") == 0)


def _before(turns: DataFrame) -> DataFrame:
    """turns(conv, turn, n, id, is_call, is_user) with `before`, the call before each, `last`, the user's call
    before each, and `next`, the call after it. A conversation's stretches of turns are worked on apart, with
    what the stretches around them hand over."""
    turns = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-1)))
    at = F.struct("turn", "n")
    call, user = F.when(F.col("is_call"), F.col("id")), F.when(F.col("is_user"), F.col("id"))
    ends = turns.groupBy("conv", "stretch").agg(F.max_by(call, F.when(F.col("is_call"), at)).alias("c"), F.max_by(user, F.when(F.col("is_user"), at)).alias("u"), F.min_by(call, F.when(F.col("is_call"), at)).alias("f"))
    w = Window.partitionBy("conv").orderBy("stretch")
    past, future = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("conv", "stretch", F.last("c", True).over(past).alias("c0"), F.last("u", True).over(past).alias("u0"), F.first("f", True).over(future).alias("f0"))
    own = Window.partitionBy("conv", "stretch").orderBy("turn", "n")
    back, on = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    near = turns.select("*", F.last(call, True).over(back).alias("c1"), F.last(user, True).over(back).alias("u1"), F.first(call, True).over(on).alias("f1"))
    near = near.join(ends, ["conv", "stretch"])
    return near.select("*", F.coalesce("c1", "c0").alias("before"), F.coalesce("u1", "u0").alias("last"), F.coalesce("f1", "f0").alias("next")).drop("c0", "c1", "u0", "u1", "f0", "f1", "stretch")


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of turns(conv_id, turn, role, text), which hold no tool calls of their own.

    System turns call `configure`, user turns `reply`; assistant turns are results of the user turn before
    them. An id is conversation and turn, and a number where several turns have both alike. A call depends on the one
    before it. By the length of a text, some calls are as models write them when they go wrong: every
    seventh asks for an unknown tool, has arguments that are no JSON, has its turn as text, has an unknown
    argument, lacks its text, or waits for the call after it as well; every fifth depends on nothing; the
    result of every eleventh assistant turn names no call. Turns of other roles are left out; null
    conversations are one, null turns come first.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = turns.select("conv_id", "turn", "role", "text").where(F.col("role").isin("system", "user", "assistant")).withColumn("n", n)
    id_ = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.when(F.col("n") > 1, F.concat(F.lit("."), F.col("n").cast("string"))).otherwise(""))
    rows = rows.select("*", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"), id_.alias("id"), F.col("role").isin("system", "user").alias("is_call"), (F.col("role") == "user").alias("is_user"))
    rows = _before(rows)
    wrong = size % 7
    name = F.when(F.col("role") == "system", "configure").when(wrong == 1, "search").otherwise("reply")
    arguments = (
        F.when(wrong == 2, F.concat(F.lit("{"), "text"))
        .when(wrong == 3, F.to_json(F.struct("text", F.col("turn").cast("string").alias("turn"))))
        .when(wrong == 4, F.to_json(F.struct("text", "turn", F.col("role").alias("who"))))
        .when(wrong == 5, F.to_json(F.struct("turn")))
        .otherwise(F.to_json(F.struct("text", "turn")))
    )
    none = F.array().cast("array<string>")
    after = F.concat(F.when((size % 5 > 0) & F.col("before").isNotNull(), F.array("before")).otherwise(none), F.when((wrong == 6) & F.col("next").isNotNull(), F.array("next")).otherwise(none))
    calls = rows.where("is_call").select("conv_id", F.col("id").alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = rows.where((F.col("role") == "assistant") & F.col("last").isNotNull())
    results = results.select(F.when(size % 11 == 0, F.concat(F.lit("lost-"), "id")).otherwise(F.col("last")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the conversations with its result, place, errors and record."""
    rows = link_tool_calls(*calls_of_turns(table(spark, sf_dir, "conversations")))
    return rows.select("conv_id", "call_id", "name", "level", F.col("place").cast("long").alias("place"), "n_results", F.col("valid"), F.array_join("errors", "; ").alias("errors"), "record")


#: Levels are the longest paths here, walked one edge a step; a path as long as there are calls holds a cycle.
OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n, length(COALESCE(text, '')) AS size
    FROM conversations WHERE role IN ('system', 'user', 'assistant')),
i AS (SELECT *, COALESCE(conv_id::VARCHAR, '') || '-' || COALESCE(turn::VARCHAR, '') || CASE WHEN n > 1 THEN '.' || n ELSE '' END AS id, role <> 'assistant' AS is_call FROM t),
b AS (SELECT *, last_value(CASE WHEN is_call THEN id END IGNORE NULLS) OVER p AS bef, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER p AS asked,
             first_value(CASE WHEN is_call THEN id END IGNORE NULLS) OVER q AS nxt FROM i
      WINDOW p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             q AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, CASE WHEN role = 'system' THEN 'configure' WHEN size % 7 = 1 THEN 'search' ELSE 'reply' END AS name, count(*) OVER (PARTITION BY conv_id) AS calls FROM b WHERE is_call),
e AS (SELECT DISTINCT id, dep, calls FROM (SELECT id, bef AS dep, calls FROM c WHERE size % 5 > 0 UNION ALL SELECT id, nxt, calls FROM c WHERE size % 7 = 6) WHERE dep IS NOT NULL),
w AS (SELECT id, id AS at, 0 AS steps FROM c UNION SELECT w.id, e.dep, steps + 1 FROM w JOIN e ON e.id = w.at WHERE steps < e.calls),
l AS (SELECT w.id, CASE WHEN max(steps) < max(calls) THEN max(steps) END AS level FROM w JOIN c ON c.id = w.id GROUP BY 1),
r AS (SELECT CASE WHEN size % 11 = 0 THEN 'lost-' || id ELSE asked END AS id, count(*)::BIGINT AS n_results, arg_min(text, (turn, text)) AS content FROM b WHERE role = 'assistant' AND asked IS NOT NULL GROUP BY 1),
f AS (SELECT c.conv_id, c.id, name, level, turn, COALESCE(n_results, 0)::BIGINT AS n_results, content,
    CASE WHEN size % 7 = 2 THEN '{"text":' || to_json('{' || text)::VARCHAR || '}' WHEN size % 7 = 5 THEN '{"turn":' || turn || '}'
         ELSE '{"text":' || to_json(text)::VARCHAR || ',"turn":' || CASE WHEN size % 7 = 3 THEN '"' || turn || '"' ELSE turn::VARCHAR END || CASE WHEN size % 7 = 4 THEN ',"who":"' || role || '"' ELSE '' END || '}' END AS args,
    list_concat(CASE WHEN size % 7 = 2 THEN ['arguments: not JSON'] ELSE [] END, CASE WHEN name = 'search' THEN ['name: no such tool'] ELSE [] END, CASE WHEN size % 7 = 5 THEN ['text: missing'] ELSE [] END,
        CASE WHEN size % 7 = 3 THEN ['turn: not BIGINT'] ELSE [] END, CASE WHEN size % 7 = 4 THEN ['unknown: who'] ELSE [] END, CASE WHEN level IS NULL THEN ['after: cycle'] ELSE [] END) AS errs
    FROM c JOIN l ON l.id = c.id LEFT JOIN r ON r.id = c.id)
SELECT conv_id, id AS call_id, name, level::INT AS level, (row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, id))::BIGINT AS place, n_results, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors,
       '{"arguments":' || args || ',"id":' || to_json(id)::VARCHAR || ',"name":"' || name || '","result":' || COALESCE(to_json(content)::VARCHAR, 'null') || '}' AS record FROM f
"""
