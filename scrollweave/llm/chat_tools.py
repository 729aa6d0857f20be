"""Chat formatting (5), native: tool-call linking.

Turns may hold ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``
and ``<tool_result>{"id", "content"}</tool_result>``. Calls are hash-joined
with results by (conversation, identifier), ordered topologically by ``after``
(identifiers of calls that must come first), their arguments validated against
schemas, and each turn is written as canonical JSON: keys sorted, no white
space, numbers in one form (a VARIANT keeps its keys sorted).

Scale: all joins are on (conversation, identifier) or on a turn; results meet
the one call that has their identifier first. No conversation is collected:
turns are rows, and order is a column. Calls that wait for one other are taken
by pointers that double their reach; then rounds of ordering run over those
that wait for several, as many as the longest chain of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Tool name -> argument -> (type, required). Types are those of try_variant_get.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("bigint", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "timeout": ("double", False)},
}
FORM = "id string, name string, arguments string, after array<string>, content string"


def _fault(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, or null."""
    has = lambda k: F.array_contains(F.map_keys("given"), k)
    fault = F.when(F.col("name").isNull() | ~F.col("name").isin(list(schemas) or [""]), "unknown_tool").when(F.col("given").isNull(), "not_an_object")
    for tool, form in schemas.items():
        here = F.col("name") == tool
        for key, (kind, needed) in form.items():
            held = F.try_element_at("given", F.lit(key))
            value, typed = F.try_variant_get(held, "$", kind), F.schema_of_variant(held)
            right = {"string": ["STRING"], "bigint": ["BIGINT"], "boolean": ["BOOLEAN"]}.get(kind)
            wrong = value.isNull() if right is None else value.isNull() | ~typed.isin(right)
            if needed:
                fault = fault.when(here & ~has(key), f"missing:{key}")
            fault = fault.when(here & has(key) & wrong, f"type:{key}")
        fault = fault.when(here & (F.size(F.array_except(F.map_keys("given"), F.array(*map(F.lit, form)).cast("array<string>"))) > 0), "unexpected_argument")
    return fault


def _parts(turns: DataFrame, tag: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    rows = turns.filter(F.col("text").contains(f"<{tag}>")).select("conv_id", "turn", "sha", F.posexplode(found).alias("i", "raw"))
    return rows.select("conv_id", "turn", "sha", "i", F.from_json("raw", FORM).alias("x")).select("conv_id", "turn", "sha", "i", "x.*")


def linked_calls(turns: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, turn, sha, i, id, name, arguments (canonical JSON), status, fault, level, result_turn: one row for each call.

    A call has the first result with its id in its turn or a later one, whose
    turn is result_turn. status: ``linked``, ``unanswered``, ``answered_early``
    (all its results stand in earlier turns), ``repeated_id`` (not the first
    with that id) or ``no_id``. level: 0 for calls that wait for none, else one
    more than the highest of those they wait for; null in a cycle and behind
    one. Unknown ids in ``after`` don't bind; calls that share an id wait for
    what any of them names.
    """
    calls = _parts(turns, "tool_call")
    given = F.expr("try_parse_json(arguments)")
    calls = calls.withColumn("args", given).withColumn("given", F.expr("try_cast(args as map<string, variant>)"))
    calls = calls.withColumn("fault", _fault(SCHEMAS if schemas is None else schemas))
    calls = settle(calls.select("conv_id", "turn", "sha", "i", "id", "name", F.to_json("args").alias("arguments"), "after", "fault"), "calls")
    first = calls.filter("id is not null").groupBy(F.col("conv_id").alias("fc"), F.col("id").alias("fid")).agg(F.min(F.struct("turn", "i")).alias("first"))
    results = _parts(turns, "tool_result").filter("id is not null").select("conv_id", "id", F.col("turn").alias("at"))
    met = results.join(first, results.conv_id.eqNullSafe(first.fc) & (results.id == first.fid))
    met = met.groupBy(F.col("fc").alias("rc"), F.col("fid").alias("rid")).agg(F.min(F.when(F.col("at") >= F.col("first.turn"), F.col("at"))).alias("result_turn"))
    out = calls.join(first, calls.conv_id.eqNullSafe(first.fc) & (calls.id == first.fid), "left")
    out = out.join(met, out.conv_id.eqNullSafe(met.rc) & (out.id == met.rid), "left")
    own = F.struct("turn", "i") == F.col("first")
    status = F.when(F.col("id").isNull(), "no_id").when(~own, "repeated_id").when(F.col("rid").isNull(), "unanswered").when(F.col("result_turn").isNull(), "answered_early").otherwise("linked")
    out = out.withColumns({"status": status, "result_turn": F.when(own, F.col("result_turn"))})
    levels = _levels(calls).withColumnsRenamed({"conv_id": "lc", "id": "lid"})
    out = out.join(levels, out.conv_id.eqNullSafe(levels.lc) & (out.id == levels.lid), "left")
    level = F.when(F.col("id").isNull(), 0).otherwise(F.col("level"))
    return out.select("conv_id", "turn", "sha", "i", "id", "name", "arguments", "status", "fault", level.alias("level"), "result_turn")


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level of all ids that aren't in a cycle or behind one."""
    nodes = calls.filter("id is not null").select("conv_id", "id").distinct()
    waits = calls.filter("id is not null").select("conv_id", "id", F.explode("after").alias("on")).distinct()
    known = nodes.withColumnsRenamed({"conv_id": "kc", "id": "kid"})
    waits = settle(waits.join(known, waits.conv_id.eqNullSafe(known.kc) & (waits.on == known.kid)).drop("kc", "kid"), "waits")
    # Those that wait for one other: how many steps back to one that doesn't.
    back = waits.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("on")).filter("n = 1").select("conv_id", "id", "on", F.lit(1).alias("steps"))
    back, left = settle(back, "back"), 0
    for _ in range(back.count().bit_length() + 1):
        next_ = back.select(F.col("conv_id").alias("nc"), F.col("id").alias("nid"), F.col("on").alias("far"), F.col("steps").alias("more"))
        met = back.join(next_, back.conv_id.eqNullSafe(next_.nc) & (back.on == next_.nid), "left")
        now = settle(met.select("conv_id", "id", F.coalesce("far", "on").alias("on"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")), "back")
        drop_settled(back)
        left = (back := now.drop("moved")) and now.filter("moved").count()
        if not left:
            break
    far = back.select(F.col("conv_id").alias("bc"), F.col("id").alias("bid"), F.col("on").alias("far"), "steps")
    # Those that wait for several wait for where these lead; what still moves runs round a cycle, and so never gets a level.
    many = waits.join(far.select("bc", "bid"), waits.conv_id.eqNullSafe(F.col("bc")) & (waits.id == F.col("bid")), "left_anti")
    many = many.join(far, many.conv_id.eqNullSafe(far.bc) & (many.on == far.bid), "left")
    waits = settle(many.select("conv_id", "id", F.coalesce("far", "on").alias("on"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "waits")
    bound = waits.select(F.col("conv_id").alias("wc"), F.col("id").alias("wid")).unionByName(far.select(F.col("bc").alias("wc"), F.col("bid").alias("wid"))).distinct()
    placed = settle(nodes.join(bound, nodes.conv_id.eqNullSafe(bound.wc) & (nodes.id == bound.wid), "left_anti").withColumn("level", F.lit(0)), "levels")
    left = waits.count()
    while left:
        done = placed.withColumnsRenamed({"conv_id": "pc", "id": "pid", "level": "at"})
        state = waits.join(done, waits.conv_id.eqNullSafe(done.pc) & (waits.on == done.pid), "left")
        ready = state.groupBy("conv_id", "id").agg(F.count(F.when(F.col("pid").isNull(), 1)).alias("open"), F.max(F.col("at") + F.col("steps")).alias("level")).filter("open = 0").select("conv_id", "id", "level")
        ready = settle(ready, "ready")
        placed = placed.unionByName(ready)
        gone = ready.select(F.col("conv_id").alias("gc"), F.col("id").alias("gid"))
        after = settle(waits.join(gone, waits.conv_id.eqNullSafe(gone.gc) & (waits.id == gone.gid), "left_anti"), "waits")
        drop_settled(waits)
        waits, before = after, left
        left = waits.count()
        if left == before:
            break
    end = placed.withColumnsRenamed({"conv_id": "pc", "id": "pid", "level": "at"})
    led = far.join(end, far.bc.eqNullSafe(end.pc) & (far.far == end.pid)).select(F.col("bc").alias("conv_id"), F.col("bid").alias("id"), (F.col("at") + F.col("steps")).alias("level"))
    return placed.unionByName(led)


def format_turns(conversations: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_results, n_linked, n_faults, level, message: one row for each row of ``conversations``.

    message is canonical JSON: content (the text without its calls and results,
    trimmed), results and tool_calls where there are any, role. tool_calls come
    by level, those in a cycle last, then by place. Null texts and
    roles count as empty; calls that are no JSON have null fields and status
    ``no_id``. Turns that repeat conversation, number and text share their
    calls. level is the highest of the turn's calls.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    marked = turns.filter(F.col("text").contains("<tool_")).select("conv_id", "turn", "sha", "text")
    marked = settle(marked.dropDuplicates(["conv_id", "turn", "sha"]), "marked")
    calls = linked_calls(marked, schemas)
    call = F.struct("arguments", "fault", "id", "level", "name", "result_turn", "status")
    calls = calls.groupBy(*(F.col(c).alias(f"c_{c}") for c in ("conv_id", "turn", "sha"))).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count(F.when(F.col("status") == "linked", 1)).alias("n_linked"),
        F.count("fault").alias("n_faults"),
        F.max("level").alias("level"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("level").isNull().alias("cyclic"), "level", "i", call.alias("call")))), lambda x: x["call"]).alias("tool_calls"),
    )
    results = _parts(marked, "tool_result").groupBy(*(F.col(c).alias(f"r_{c}") for c in ("conv_id", "turn", "sha")))
    results = results.agg(F.count(F.lit(1)).alias("n_results"), F.transform(F.sort_array(F.collect_list(F.struct("i", F.struct("content", "id").alias("x")))), lambda x: x["x"]).alias("results"))
    same = lambda t, p: turns.conv_id.eqNullSafe(t[f"{p}_conv_id"]) & turns.turn.eqNullSafe(t[f"{p}_turn"]) & (turns.sha == t[f"{p}_sha"])
    out = turns.join(calls, same(calls, "c"), "left").join(results, same(results, "r"), "left")
    content = F.trim(F.regexp_replace("text", r"(?s)<tool_call>.*?</tool_call>|<tool_result>.*?</tool_result>", ""))
    message = F.to_json(F.struct(content.alias("content"), "results", "role", "tool_calls"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", zero("n_calls"), zero("n_results"), zero("n_linked"), zero("n_faults"), F.col("level").cast("int").alias("level"), message.alias("message"))


def with_tools(conversations: DataFrame) -> DataFrame:
    """``conversations`` with calls and results in their turns, made by arithmetic.

    The table has none. Assistants get up to three calls in each turn: some
    without an id or with one that repeats, with wrong arguments, that wait for
    calls after them, for earlier turns, or in a circle. Other turns get
    results: of most calls of the turn before, of older ones, and too early.
    """
    call = """transform(filter(sequence(0, 2), j -> role = 'assistant' and j < pmod(conv_id + turn, 4)), j -> concat('<tool_call>{', case
        when pmod(conv_id + 3 * turn + j, 13) = 5 then '' when pmod(conv_id + turn * j + j, 11) = 7 then '"id": "x", ' else concat('"id": "c', turn, '_', j, '", ') end,
        '"name": "', element_at(array('search', 'calculator', 'fetch', 'search', 'calculator', 'fetch', 'search', 'calculator', 'other'), cast(pmod(conv_id + 2 * turn + 3 * j, 9) as int) + 1), '", "arguments": ',
        element_at(array(concat('{"query": "q', turn, '", "limit": ', j, '}'), concat('{"expression": "1+', j, '"}'), concat('{"url": "u/x", "timeout": ', j, '.5}'), '{"query": 7}', '{"query": "x", "more": true}'), cast(if(pmod(2 * conv_id + turn + j, 5) < 3, pmod(conv_id + 2 * turn + 3 * j, 9) % 3, pmod(2 * conv_id + turn + j, 5)) as int) + 1),
        ', "after": [', case when j + 1 < pmod(conv_id + turn, 4) then concat('"c', turn, '_', j + 1, '"') when j > 0 and pmod(conv_id, 5) = 3 then concat('"c', turn, '_0"') when turn >= 2 then concat('"c', turn - 2, '_0", "c', turn - 1, '_0", "c', turn - 3, '_1"') else '' end, ']}</tool_call>'))"""
    result = """transform(filter(sequence(0, 5), j -> role <> 'assistant' and case when j < 3 then turn >= 1 and pmod(conv_id + turn + j, 3) <> 0 when j = 3 then pmod(conv_id + turn, 5) = 1 when j = 4 then pmod(conv_id + turn, 7) = 3 else turn >= 4 and pmod(conv_id + turn, 2) = 0 end),
        j -> concat('<tool_result>{"id": "', case when j < 3 then concat('c', turn - 1, '_', j) when j = 3 then 'x' when j = 4 then concat('c', turn + 1, '_0') else concat('c', turn - 3, '_0') end, '", "content": "r', turn, '.', j, '"}</tool_result>'))"""
    tags = F.coalesce(F.concat(F.array_join(F.expr(call), ""), F.array_join(F.expr(result), "")), F.lit(""))
    return conversations.withColumn("text", F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), tags))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(with_tools(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The calls and results of :func:`with_tools`, linked and written without parsing them. A depth of 64 is a cycle: no conversation has as many calls.
ORACLE_SQL = """
WITH RECURSIVE
calls AS (
  SELECT conv_id, turn, j AS i,
    CASE WHEN (conv_id + 3 * turn + j) % 13 = 5 THEN NULL WHEN (conv_id + turn * j + j) % 11 = 7 THEN 'x' ELSE 'c' || turn || '_' || j END AS id,
    ['search', 'calculator', 'fetch', 'search', 'calculator', 'fetch', 'search', 'calculator', 'other'][(conv_id + 2 * turn + 3 * j) % 9 + 1] AS name,
    [concat('{"limit":', j, ',"query":"q', turn, '"}'), concat('{"expression":"1+', j, '"}'), concat('{"timeout":', j, '.5,"url":"u/x"}'), '{"query":7}', '{"more":true,"query":"x"}'][CASE WHEN (2 * conv_id + turn + j) % 5 < 3 THEN (conv_id + 2 * turn + 3 * j) % 9 % 3 ELSE (2 * conv_id + turn + j) % 5 END + 1] AS arguments,
    CASE WHEN j + 1 < (conv_id + turn) % 4 THEN ['c' || turn || '_' || (j + 1)] WHEN j > 0 AND conv_id % 5 = 3 THEN ['c' || turn || '_0'] WHEN turn >= 2 THEN ['c' || (turn - 2) || '_0', 'c' || (turn - 1) || '_0', 'c' || (turn - 3) || '_1'] ELSE [] END AS after
  FROM conversations, (SELECT unnest([0, 1, 2]) AS j) WHERE role = 'assistant' AND j < (conv_id + turn) % 4),
results AS (
  SELECT conv_id, turn, j AS i, 'r' || turn || '.' || j AS content, CASE WHEN j < 3 THEN 'c' || (turn - 1) || '_' || j WHEN j = 3 THEN 'x' WHEN j = 4 THEN 'c' || (turn + 1) || '_0' ELSE 'c' || (turn - 3) || '_0' END AS id
  FROM conversations, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS j)
  WHERE role <> 'assistant' AND CASE WHEN j < 3 THEN turn >= 1 AND (conv_id + turn + j) % 3 <> 0 WHEN j = 3 THEN (conv_id + turn) % 5 = 1 WHEN j = 4 THEN (conv_id + turn) % 7 = 3 ELSE turn >= 4 AND (conv_id + turn) % 2 = 0 END),
first_ AS (SELECT conv_id, id, min(turn * 10 + i) AS place, min(turn) AS turn FROM calls WHERE id IS NOT NULL GROUP BY ALL),
met AS (SELECT conv_id, id, min(r.turn) FILTER (r.turn >= f.turn) AS result_turn FROM results r JOIN first_ f USING (conv_id, id) GROUP BY ALL),
waits AS (SELECT DISTINCT w.conv_id, w.id, w.before FROM (SELECT conv_id, id, unnest(after) AS before FROM calls WHERE id IS NOT NULL) w JOIN first_ f ON f.conv_id = w.conv_id AND f.id = w.before),
depths AS (
  SELECT conv_id, id, 0 AS depth FROM first_
  UNION
  SELECT w.conv_id, w.id, d.depth + 1 FROM depths d JOIN waits w ON w.conv_id = d.conv_id AND w.before = d.id WHERE d.depth < 64),
levels AS (SELECT conv_id, id, CASE WHEN max(depth) < 64 THEN max(depth) END AS level FROM depths GROUP BY ALL),
linked AS (
  SELECT c.conv_id, c.turn, c.i, c.id, c.name, c.arguments, CASE WHEN c.id IS NULL THEN 0 ELSE level END AS level,
    CASE WHEN c.id IS NULL THEN 'no_id' WHEN c.turn * 10 + c.i <> place THEN 'repeated_id' WHEN m.id IS NULL THEN 'unanswered' WHEN m.result_turn IS NULL THEN 'answered_early' ELSE 'linked' END AS status,
    CASE WHEN c.turn * 10 + c.i = place THEN m.result_turn END AS result_turn,
    CASE c.name
      WHEN 'search' THEN CASE WHEN NOT json_exists(arguments, '$.query') THEN 'missing:query' WHEN json_type(arguments, '$.query') <> 'VARCHAR' THEN 'type:query' WHEN json_exists(arguments, '$.limit') AND json_type(arguments, '$.limit') NOT IN ('UBIGINT', 'BIGINT') THEN 'type:limit' WHEN len(list_filter(json_keys(arguments), lambda k: k NOT IN ('query', 'limit'))) > 0 THEN 'unexpected_argument' END
      WHEN 'calculator' THEN CASE WHEN NOT json_exists(arguments, '$.expression') THEN 'missing:expression' WHEN json_type(arguments, '$.expression') <> 'VARCHAR' THEN 'type:expression' WHEN len(json_keys(arguments)) > 1 THEN 'unexpected_argument' END
      WHEN 'fetch' THEN CASE WHEN NOT json_exists(arguments, '$.url') THEN 'missing:url' WHEN json_type(arguments, '$.url') <> 'VARCHAR' THEN 'type:url' WHEN json_exists(arguments, '$.timeout') AND json_type(arguments, '$.timeout') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'type:timeout' WHEN len(list_filter(json_keys(arguments), lambda k: k NOT IN ('url', 'timeout'))) > 0 THEN 'unexpected_argument' END
      ELSE 'unknown_tool' END AS fault
  FROM calls c LEFT JOIN first_ f ON f.conv_id = c.conv_id AND f.id = c.id LEFT JOIN met m ON m.conv_id = c.conv_id AND m.id = c.id LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.id = c.id),
said AS (
  SELECT conv_id, turn, count(*) AS n_calls, count(*) FILTER (status = 'linked') AS n_linked, count(fault) AS n_faults, max(level) AS level,
    string_agg(concat('{"arguments":', to_json(arguments), ',"fault":' || to_json(fault), ',"id":' || to_json(id), ',"level":' || level, ',"name":', to_json(name), ',"result_turn":' || result_turn, ',"status":', to_json(status), '}'), ',' ORDER BY level IS NULL, level, i) AS tool_calls
  FROM linked GROUP BY ALL),
heard AS (SELECT conv_id, turn, count(*) AS n_results, string_agg(concat('{"content":', to_json(content), ',"id":', to_json(id), '}'), ',' ORDER BY i) AS results FROM results GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(c.role, '') AS role, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(n_faults, 0)::BIGINT AS n_faults, level::INT AS level,
  concat('{"content":', to_json(trim(coalesce(c.text, ''), ' ')), ',"results":[' || results || ']', ',"role":', to_json(coalesce(c.role, '')), ',"tool_calls":[' || tool_calls || ']', '}') AS message
FROM conversations c LEFT JOIN said s ON s.conv_id = c.conv_id AND s.turn = c.turn LEFT JOIN heard h ON h.conv_id = c.conv_id AND h.turn = c.turn
"""
