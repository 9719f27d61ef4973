"""Chat formatting with tool calls: calls are linked to results, ordered, checked and serialised.

Calls and results meet in a hash join on conversation and call id. A call may name calls that must
come before it; levels of the resulting graph are found in rounds, each a few joins over the calls
that are still open. In a round, calls whose dependencies are settled settle, and a dependency on a
call that itself waits for one other call only is handed on to that one, so chains shrink by half.
Arguments are parsed as variants, checked against the tool's schema, and written as canonical JSON
(keys sorted, no spaces). The output has one row for each call, never one for each conversation,
so a conversation of any length is no burden for a task.

Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: JSON type by the name that Spark gives a variant's type.
TYPES = (("BIGINT", "integer"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("FLOAT", "number"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"))

#: Conversations of the query in which the first call waits for the second, which makes a cycle.
CYCLES = (13, 5)
#: Tools of the query over ``conversations``: {tool: {argument: (JSON type, required)}}.
TOOLS = {
    "configure": {"chars": ("integer", True), "text": ("string", True)},
    "ask": {"chars": ("integer", True), "text": ("string", True), "turn": ("integer", False)},
}


def json_type(v: Column) -> Column:
    kind, out = F.schema_of_variant(v), F.lit(None).cast("string")
    for prefix, name in TYPES:
        out = F.when(kind.startswith(prefix), name).otherwise(out)
    return out


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from messages ``conv_id, turn, role, text`` whose texts are JSON.

    A call is an element of ``tool_calls`` in an assistant's text, ``{"id", "name", "arguments",
    "after"}``; a result is a tool's text ``{"tool_call_id", "content"}``. Other texts have none.
    """
    call = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"
    read = messages.select("conv_id", "turn", "role", F.try_parse_json("text").alias("v"))
    many = read.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", call)).alias("nth", "c"))
    calls = many.select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    got = read.where("role = 'tool' AND v IS NOT NULL").select("conv_id", "turn", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"), F.try_variant_get("v", "$.content", "string").alias("content"))
    return calls, got.where("call_id IS NOT NULL")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without known dependencies, else one more than the largest of theirs.

    ``calls`` has one row per conversation and call id, with ``after``. Dependencies on calls that
    are not there don't count. Calls on a cycle, or behind one, are not in the result: every round
    settles a call unless all that are left are such.
    """
    key, edge_key = ["conv_id", "call_id"], ["conv_id", "before"]
    edge = calls.select(*key, F.explode(F.array_distinct("after")).alias("before"))
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    # an edge says: one's level is the other's plus ``w`` at least
    edges = stored(edge.join(known, edge_key).select(*key, "before", F.lit(1).cast("long").alias("w")))
    open_calls = stored(edges.select(*key).distinct().withColumn("base", F.lit(0).cast("long")))
    done = calls.select(*key).join(open_calls, key, "left_anti").withColumn("level", F.lit(0).cast("long"))
    if open_calls.isEmpty():
        return done.withColumn("level", F.col("level").cast("int"))
    # calls nobody waits for need no further look
    fresh = stored(done.join(edges.select("conv_id", F.col("before").alias("call_id")), key, "left_semi"))
    while not fresh.isEmpty():
        settled = fresh.select("conv_id", F.col("call_id").alias("before"), "level")
        met = stored(edges.join(settled, edge_key, "left").select(*key, "before", "w", (F.col("level") + F.col("w")).alias("at_least")))
        rest = met.where("at_least IS NULL").select(*key, "before", "w")
        state = met.groupBy(*key).agg(F.max("at_least").alias("reached"), F.count_if(F.col("at_least").isNull()).alias("k"), *[F.max(F.when(F.col("at_least").isNull(), F.col(c))).alias(f"one_{c}") for c in ("before", "w")])
        state = stored(open_calls.join(state, key).select(*key, F.greatest("base", "reached").alias("base"), "k", "one_before", "one_w"))
        fresh = stored(state.where("k = 0").select(*key, F.col("base").alias("level")))
        done = done.union(fresh)
        single = state.where("k = 1 AND one_before <> call_id").select("conv_id", F.col("call_id").alias("before"), F.col("base").alias("s_base"), "one_before", "one_w")
        handed = stored(rest.join(single, edge_key, "left"))
        raised = handed.where("one_before IS NOT NULL").groupBy(*key).agg(F.max(F.col("s_base") + F.col("w")).alias("raised"))
        open_calls = stored(state.where("k > 0").select(*key, "base").join(raised, key, "left").select(*key, F.greatest("base", "raised").alias("base")))
        moved = handed.select(*key, F.coalesce("one_before", "before").alias("before"), (F.col("w") + F.coalesce("one_w", F.lit(0))).alias("w"))
        edges = stored(moved.groupBy(*key, "before").agg(F.max("w").alias("w")))
    return done.withColumn("level", F.col("level").cast("int"))


def _errors(name: Column, raw: Column, v: Column, tools: dict) -> Column:
    """What is wrong with the arguments: sorted texts, empty if nothing is."""
    out = F.when(name.isNull() | ~name.isin(list(tools)), F.array(F.lit("unknown tool")))
    out = out.when(v.isNull(), F.array(F.lit("arguments are not JSON")))
    out = out.when(json_type(v) != "object", F.array(F.lit("arguments are not an object")))
    for tool, params in tools.items():
        found = [F.lit(None).cast("string")]
        # names beside the schema's; a variant's objects read as maps
        extra = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*[F.lit(p) for p in params]).cast("array<string>"))
        for param, (kind, required) in params.items():
            have = F.try_variant_get(v, f"$.{param}", "variant")
            missing = F.when(have.isNull(), f"{param}: missing") if required else F.lit(None).cast("string")
            fits = json_type(have).isin(["integer", "number"] if kind == "number" else [kind])
            found.append(F.coalesce(missing, F.when(have.isNotNull() & ~fits, f"{param}: not {kind}")))
        wrong = F.concat(F.array_compact(F.array(*found)), F.transform(extra, lambda x: F.concat(x, F.lit(": unknown"))))
        out = out.when(name == tool, F.array_sort(wrong))
    return out.otherwise(F.array().cast("array<string>"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict) -> DataFrame:
    """``conv_id, turn, nth, call_id, name, level, status, errors, json`` for calls and stray results.

    ``calls``: conv_id, turn, nth, call_id, name, arguments (JSON text), after (call ids).
    ``results``: conv_id, turn, call_id, content. Order within a conversation is (level, turn, nth).

    The status is the first that applies: ``orphan`` (a result without a call; level null),
    ``repeated`` (a call whose id an earlier one has, or a result after the first), ``cyclic``
    (level null), ``invalid`` (errors in the arguments), ``unanswered``, ``ok``. A null id never
    meets another: such a call is unanswered, such a result an orphan. Of repeated calls and
    results the first by turn, nth and content counts. Nulls in other columns are kept; null
    arguments aren't JSON. Empty tables give what the other side leaves; further columns are
    ignored.
    """
    key = ["conv_id", "call_id"]
    own = stored(calls.select("conv_id", "turn", "nth", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    got = stored(results.select("conv_id", "turn", "call_id", "content"))
    usable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # repeated ids shrink before the shuffle; the row of the least position stands for its id
    place = F.struct("turn", "nth", F.xxhash64("name", "arguments").alias("h"))
    first = stored(own.where(usable).groupBy(*key).agg(F.min(place).alias("at"), F.min_by("after", place).alias("after")))
    answer = stored(got.where(usable).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer")))
    level = levels(first.select(*key, "after"))
    heads = first.select(*key, "at").join(level, key, "left").join(answer, key, "left")
    joined = own.withColumn("place", place).join(heads, key, "left")
    v = F.try_parse_json("arguments")
    rows = joined.withColumn("v", v)
    repeated = F.col("at").isNotNull() & (F.col("place") != F.col("at"))
    errors = _errors(F.col("name"), F.col("arguments"), F.col("v"), tools)
    rows = rows.withColumn("errors", errors).withColumn("same", repeated)
    status = F.when(F.col("same"), "repeated").when(usable & F.col("level").isNull(), "cyclic").when(F.size("errors") > 0, "invalid").when(F.col("answer").isNull(), "unanswered").otherwise("ok")
    body = F.to_json(F.struct(F.col("v").alias("arguments"), F.when(~F.col("same"), F.col("answer.content")).alias("content"), F.col("call_id").alias("id"), "name", status.alias("status")), {"ignoreNullFields": "false"})
    linked = rows.select("conv_id", "turn", "nth", "call_id", "name", F.when(~F.col("same"), F.coalesce("level", F.when(~usable, 0))).alias("level"), status.alias("status"), "errors", body.alias("json"))
    # results that no call took: those without a call, and those after the first
    free = got.join(first.select(*key, F.lit(True).alias("called")), key, "left").join(answer, key, "left")
    taken = F.col("called") & F.struct("turn", "content").eqNullSafe(F.col("answer"))
    state = F.when(F.col("called").isNull(), "orphan").otherwise("repeated")
    left = free.where(~F.coalesce(taken, F.lit(False)))
    body = F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"), state.alias("status")), {"ignoreNullFields": "false"})
    none = F.lit(None)
    stray = left.select("conv_id", "turn", none.cast("long").alias("nth"), "call_id", none.cast("string").alias("name"), none.cast("int").alias("level"), state.alias("status"), F.array().cast("array<string>").alias("errors"), body.alias("json"))
    return linked.unionByName(stray)


def dialogue_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations read as tool use: a user's turn calls ``ask``, a system's turn ``configure``.

    An assistant's turn is the result of the call made in the turn before it. A question waits for
    the calls of the two turns before it, so a conversation is a chain; in some (CYCLES) its first
    call waits for the second. A text with line breaks adds an argument that no schema has; an
    empty one lacks an argument that is required.
    """
    ident = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    asked = messages.where(F.col("role").isin("user", "system"))
    user = F.col("role") == "user"
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    made = F.to_json(F.struct(F.length(text).alias("chars"), F.when(lines > 0, lines).alias("lines"), F.nullif(text, F.lit("")).alias("text"), F.when(user, turn).alias("turn")))
    after = F.when(user, F.array(ident(turn - 1), ident(turn - 2))).otherwise(F.array().cast("array<string>"))
    circle = (F.col("conv_id") % CYCLES[0] == CYCLES[1]) & (turn == 0)
    after = F.concat(after, F.when(circle, F.array(ident(turn + 1), ident(turn + 2))).otherwise(F.array().cast("array<string>")))
    calls = asked.select("conv_id", "turn", F.lit(0).cast("long").alias("nth"), ident(turn).alias("call_id"), F.when(user, "ask").otherwise("configure").alias("name"), made.alias("arguments"), after.alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_dialogues(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, call_id, level, status, n_errors, json_sha256`` for every call and stray result."""
    out = link_calls(*dialogue_calls(messages), TOOLS)
    return out.select("conv_id", "turn", "call_id", "level", "status", F.size("errors").cast("long").alias("n_errors"), F.sha2("json", 256).alias("json_sha256"))


#: Levels are the longest of all paths, cycles what reaches itself; both by recursion over few turns.
ORACLE_SQL = f"""
    WITH RECURSIVE call AS (
        SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, role, coalesce(text, '') AS t,
               length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS lines
        FROM conversations WHERE role IN ('user', 'system')),
    edge AS (SELECT c.conv_id, c.turn AS a, b.turn AS z FROM call c JOIN call b ON b.conv_id = c.conv_id
             WHERE c.role = 'user' AND b.turn IN (c.turn - 1, c.turn - 2) OR c.conv_id % {CYCLES[0]} = {CYCLES[1]} AND c.turn = 0 AND b.turn IN (1, 2)),
    reach AS (SELECT conv_id, a, z FROM edge UNION SELECT r.conv_id, r.a, e.z FROM reach r JOIN edge e ON e.conv_id = r.conv_id AND e.a = r.z),
    loops AS (SELECT conv_id, a FROM reach WHERE a = z),
    dead AS (SELECT conv_id, a FROM loops UNION SELECT r.conv_id, r.a FROM reach r JOIN loops l ON l.conv_id = r.conv_id AND l.a = r.z),
    path AS (SELECT conv_id, turn, 0 AS n FROM call WHERE (conv_id, turn) NOT IN (SELECT (conv_id, a) FROM edge)
             UNION SELECT e.conv_id, e.a, p.n + 1 FROM path p JOIN edge e ON e.conv_id = p.conv_id AND e.z = p.turn WHERE (e.conv_id, e.a) NOT IN (SELECT (conv_id, a) FROM dead)),
    depth AS (SELECT conv_id, turn, max(n) AS level FROM path GROUP BY ALL),
    res AS (SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
    linked AS (SELECT c.conv_id, c.turn, c.call_id, c.role, c.t, d.level, r.text AS content, CAST((c.lines > 0) AS BIGINT) + CAST((c.t = '') AS BIGINT) AS n_errors,
                      CASE WHEN d.level IS NULL THEN 'cyclic' WHEN c.lines > 0 OR c.t = '' THEN 'invalid' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
                      '{{"chars":' || length(c.t) || CASE WHEN c.lines > 0 THEN ',"lines":' || c.lines ELSE '' END || CASE WHEN c.t <> '' THEN ',"text":' || to_json(c.t) ELSE '' END
                      || CASE WHEN c.role = 'user' THEN ',"turn":' || c.turn ELSE '' END || '}}' AS args
               FROM call c LEFT JOIN depth d ON d.conv_id = c.conv_id AND d.turn = c.turn LEFT JOIN res r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
    SELECT conv_id, turn, call_id, CAST(level AS INTEGER) AS level, status, n_errors,
           sha256('{{"arguments":' || args || ',"content":' || coalesce(to_json(content), 'null') || ',"id":' || to_json(call_id) || ',"name":"' || CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END || '","status":"' || status || '"}}') AS json_sha256
    FROM linked
    UNION ALL
    SELECT r.conv_id, r.turn, r.call_id, NULL, 'orphan', 0, sha256(CAST(json_object('content', r.text, 'id', r.call_id, 'status', 'orphan') AS VARCHAR))
    FROM res r LEFT JOIN call c ON c.conv_id = r.conv_id AND c.call_id = r.call_id WHERE c.call_id IS NULL
"""
