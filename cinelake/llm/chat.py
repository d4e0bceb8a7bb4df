"""Chat formatting: tool calls linked to results by identifier, ordered, validated and serialised, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.llm.common import materialize, scratch_path

#: Type names that Spark gives to the values of each type of a tool's schema.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}

Schemas = dict[str, dict[str, tuple[str, bool]]]  # tool -> argument -> (type, required)


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (JSON text) under its tool's schema, as an array in a fixed order."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            path = "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"
            own = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            there = F.array_contains(keys, field)
            found.append(F.when(there & ~F.coalesce(own.rlike(TYPES[kind]), F.lit(False)), F.lit(f"{field} is not of type {kind}")))
            if required:
                found.append(F.when(~there, F.lit(f"{field} is missing")))
        more = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))), lambda k: F.concat(k, F.lit(" is unexpected")))
        errors = F.array_compact(F.concat(F.array(*found).cast("array<string>"), more))
        whole = F.when(keys.isNull() | value.isNull(), F.array(F.lit("arguments are not a JSON object"))).otherwise(errors)
        out = F.when(name == tool, whole).otherwise(out)
    return F.when(name.isNull(), F.array(F.lit("unknown tool"))).otherwise(out)


def _chains(single: DataFrame) -> DataFrame:
    """call_id, top, dist: the first call up a chain of calls with one need each that hasn't one need, and the steps to it.

    single: call_id, need. Pointers double, so the rounds grow with the logarithm of the longest chain. A round that ends
    no chain is the last, as a chain that doesn't run in a cycle has a call for each number of steps up to its length. top
    is null for calls in a cycle or behind one.
    """
    now = materialize(single.select("call_id", F.col("need").alias("top"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("moved")), "chains")
    before, left = 0, now.count()
    while left and left != before:
        up = now.select(F.col("call_id").alias("at"), F.col("top").alias("next"), F.col("dist").alias("more"))
        met = now.join(up, F.col("top") == F.col("at"), "left")
        met = met.select("call_id", F.coalesce("next", "top").alias("top"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("at").isNotNull().alias("moved"))
        now = materialize(met, "chains")
        before, left = left, now.where("moved").count()
    return now.select("call_id", F.when(~F.col("moved"), F.col("top")).alias("top"), "dist")


def call_levels(calls: DataFrame) -> DataFrame | None:
    """call_id, level for calls that need other calls' results; a null level marks a cycle. None if no call needs any.

    calls: call_id, needs (array of call ids). A call without needs has level 0, its results 1; a call comes after the
    results it needs. Chains of calls with a single need are walked by doubling; ready calls of the rest leave round by
    round, so the number of rounds is the depth of calls with several needs, and a logarithm for the chains between them. A
    round reads only calls and needs that still wait: levels are handed on to the waiting calls when a call leaves.
    """
    edges = calls.where("call_id IS NOT NULL").select("call_id", F.explode("needs").alias("need")).distinct()
    edges = materialize(edges.join(calls.select(F.col("call_id").alias("need")).distinct(), "need", "left_semi"), "needs")
    if edges.isEmpty():
        return None
    counts = materialize(edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")), "counts")
    chains = _chains(counts.where("n = 1"))
    several = edges.join(counts.where("n > 1").select("call_id"), "call_id", "left_semi")
    via = chains.withColumnRenamed("call_id", "need")
    weighted = several.join(via, "need", "left").select("call_id", F.coalesce("top", "need").alias("need"), (2 + 2 * F.coalesce("dist", F.lit(0))).alias("weight"))
    edges = weighted.groupBy("call_id", "need").agg(F.max("weight").alias("weight"))
    stuck = chains.where("top IS NULL").select("call_id", F.lit(True).alias("stuck"))
    pending = materialize(counts.where("n > 1").select("call_id", F.lit(False).alias("stuck")).unionByName(stuck), "pending")
    edges = edges.join(pending.select(F.col("call_id").alias("need"), F.lit(True).alias("waits")), "need", "left")
    edges = materialize(edges.withColumn("waits", F.col("waits").isNotNull()), "several")
    free = edges.where("NOT waits").groupBy("call_id").agg(F.max("weight").alias("level"))
    pending = materialize(pending.join(free, "call_id", "left"), "pending")
    edges, spark, home, rounds = edges.where("waits").drop("waits"), calls.sparkSession, scratch_path(calls.sparkSession, "ready"), 0
    schema = pending.select("call_id", "level").schema
    while True:
        # level: the most that needs which left in earlier rounds ask for; edges: only those to calls that still wait
        path = f"{home}/{rounds}"
        pending.where("NOT stuck").join(edges.select("call_id").distinct(), "call_id", "left_anti").select("call_id", "level").write.parquet(path)
        ready = spark.read.schema(schema).parquet(path)
        if ready.isEmpty():
            break
        rounds += 1
        gone = ready.select(F.col("call_id").alias("need"), F.col("level").alias("before"))
        met = materialize(edges.join(gone.withColumn("met", F.lit(True)), "need", "left"), "several")
        edges = met.where("met IS NULL").select("call_id", "need", "weight")
        asked = met.where("met").groupBy("call_id").agg(F.max(F.col("before") + F.col("weight")).alias("asked"))
        pending = pending.join(ready.select("call_id"), "call_id", "left_anti").join(asked, "call_id", "left")
        pending = materialize(pending.select("call_id", "stuck", F.greatest("level", "asked").alias("level")), "pending")
    done = spark.read.schema(schema).parquet(*[f"{home}/{i}" for i in range(rounds + 1)])  # one scan; the last has no rows
    found = done.unionByName(pending.select("call_id", F.lit(None).cast("long").alias("level")))
    tops = found.select(F.col("call_id").alias("top"), "level", F.lit(True).alias("there"))
    single = chains.where("top IS NOT NULL").join(tops, "top", "left")
    single = single.select("call_id", (F.when(F.col("there"), F.col("level")).otherwise(0) + 2 * F.col("dist")).alias("level"))
    return found.unionByName(single).select("call_id", F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result: conv_id, turn, kind, call_id, name, status, level, valid, errors, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids, null for none). results:
    conv_id, turn, call_id, content. Other columns are not read.

    status: a call is ``answered`` or ``pending``, or ``duplicate`` if an earlier call (by conv_id, turn, name, arguments)
    has its id; a result is ``linked`` or ``orphan``. Null ids link with nothing. level is the place in the topological
    order: a call comes after the results that it needs, a result after its call; orphans have level 0, calls in a cycle
    none. valid and errors come from the tool's schema (argument_errors); a result is valid if it is linked. Null or
    unreadable arguments are an error. Repeated rows of a call are one call and its duplicates share its status; repeated
    results are each linked. The needs that count are those of the first call with an id. json: the row as canonical JSON: sorted keys, no blanks, arguments parsed and sorted too (as
    plain text if they can't be parsed), nulls left out. Empty tables give no rows.

    Calls are reduced to one per id before the shuffled hash join, which can split an id that many results share.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "needs").withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), schemas))
    place = F.struct("conv_id", "turn", "name", "arguments")
    first = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct(place.alias("first"), "needs")).alias("f")).select("call_id", "f.*")
    levels = call_levels(first.select("call_id", "needs"))
    first = first.select("call_id", "first", F.col("first.name").alias("tool"))
    first = first.withColumn("level", F.lit(0)) if levels is None else first.join(levels.withColumn("found", F.lit(True)), "call_id", "left").withColumn("level", F.when(F.col("found"), F.col("level")).otherwise(0)).drop("found")
    answers = results.where("call_id IS NOT NULL").groupBy(F.col("call_id").alias("id")).agg(F.lit(True).alias("answered"))
    known = first.join(answers, F.col("call_id") == F.col("id"), "left").select(F.col("call_id").alias("id"), "first", "tool", "level", "answered")
    known = materialize(known, "calls").hint("shuffle_hash")

    made = calls.join(known, F.col("call_id") == F.col("id"), "left")
    status = F.when(F.col("id").isNotNull() & ~place.eqNullSafe(F.col("first")), "duplicate").when(F.col("answered"), "answered").otherwise("pending")
    parsed = F.try_parse_json("arguments")
    level = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("level"))
    made = made.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", status.alias("status"), level.alias("level"), "errors", parsed.alias("parsed"), F.col("arguments").alias("raw"))
    body = F.when(
        F.col("parsed").isNotNull(), F.to_json(F.struct(F.col("parsed").alias("arguments"), "call_id", "conv_id", "errors", "kind", "level", "name", "status", "turn"))
    ).otherwise(F.to_json(F.struct(F.col("raw").alias("arguments"), "call_id", "conv_id", "errors", "kind", "level", "name", "status", "turn")))
    made = made.select("conv_id", "turn", "kind", "call_id", "name", "status", "level", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), body.alias("json"))

    known_r = known.select(F.col("id"), F.col("tool").alias("name"), (F.col("level") + 1).alias("level"))
    got = results.select("conv_id", "turn", "call_id", "content").join(known_r, F.col("call_id") == F.col("id"), "left")
    got = got.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", "name", F.when(F.col("id").isNotNull(), "linked").otherwise("orphan").alias("status"),
        F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"), F.col("id").isNotNull().alias("valid"), F.lit("").alias("errors"), "content",
    )
    body = F.to_json(F.struct("call_id", "content", "conv_id", "kind", "level", "name", "status", "turn"))
    got = got.select("conv_id", "turn", "kind", "call_id", "name", "status", "level", "valid", "errors", body.alias("json"))
    return made.unionByName(got)


#: The tools that turns of a conversation call: a user's turn asks for a reply, a system turn sets the scene.
SCHEMAS: Schemas = {"reply": {"n_chars": ("integer", True), "text": ("string", True)}, "configure": {"text": ("string", True)}}


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results of the conversations: see op8_chat."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    call_id = lambda turn: F.concat("conv_id", F.lit("-"), turn)
    user, asks = F.col("role") == "user", F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    order = W.partitionBy("conv_id").orderBy("turn")
    before, every = order.rangeBetween(W.unboundedPreceding, -1), W.partitionBy("conv_id")
    asked = F.max(F.when(asks, F.col("turn"))).over(order.rangeBetween(-1, -1))
    turns = turns.withColumn("answers", F.when(~asks, asked))
    turns = turns.withColumns({"last": F.max("answers").over(before), "lead": F.min("answers").over(every), "final": F.max("answers").over(every)})
    pair = F.when(F.col("answers").isNotNull(), F.struct("answers", "last"))
    turns = turns.withColumn("second", F.max(pair).over(before)["last"])
    turns = turns.where(asks).withColumn("k", F.when(user, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(12)))).unionByName(turns.where(~asks).withColumn("k", F.lit(None).cast("long")))
    two = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 2
    ring = (F.pmod("conv_id", F.lit(10)) == 7) & (F.col("turn") == F.col("lead")) & (F.col("lead") < F.col("final"))
    needs = F.array_compact(F.array(call_id(F.col("last")), F.when(two, call_id(F.col("second"))), F.when(ring, call_id(F.col("final")))))
    k, size = F.col("k"), F.length("text").alias("n_chars")
    arguments = (
        F.when(k.isNull() | (k == 2), F.to_json(F.struct("text")))
        .when(k == 1, F.to_json(F.struct(size.cast("string").alias("n_chars"), "text")))
        .when(k == 3, F.to_json(F.struct(F.lit(1).alias("extra"), size, "text")))
        .when(k == 4, '{"text"')
        .when(k != 5, F.to_json(F.struct(size, "text")))
    )
    name = F.when(k == 6, "guess").when(user, "reply").otherwise("configure")
    calls = turns.where(asks).select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    again = calls.where((F.col("name") != "configure") & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) == 3))
    again = again.withColumns({"turn": F.col("turn") + 1000, "name": F.lit("configure"), "arguments": F.lit('{"text":"again"}')})
    results = turns.where(~asks).select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    lost = results.where(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(13)) == 5).withColumns({"turn": F.col("turn") + 1000, "call_id": F.concat("conv_id", F.lit("-lost"))})
    return calls.unionByName(again), results.unionByName(lost)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``link_tool_calls`` of all conversations, nulls, repeated rows and empty tables as stated there.

    Each user or system turn is a call with the id ``conv_id-turn``, each other turn the result of the turn before (an
    orphan if that is no call). A call needs the last call that was answered before it. By conv_id + turn, a call needs the
    one answered before that, too (modulo 5: 2), has a number as text, no number, an argument too many, unreadable or no
    arguments, or a tool that isn't known (modulo 12: 1 to 6), or is made again under the same id (modulo 11: 3); a result
    comes a second time, under an id that no call has (modulo 13: 5). In each tenth conversation the first answered call needs the last one, so that its calls form a ring.
    """
    return link_tool_calls(*_turns(spark, sf_dir), SCHEMAS)


# A call's level is twice the number of answered calls whose answers come before it, and null in and behind a ring.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, text, role, coalesce(role IN ('user', 'system'), false) AS asks FROM conversations
), answered AS (
  SELECT DISTINCT c.conv_id, c.turn FROM t c JOIN t r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND NOT r.asks WHERE c.asks
), ring AS (
  SELECT conv_id, min(turn) AS lead FROM answered WHERE conv_id % 10 = 7 GROUP BY conv_id HAVING count(*) > 1
), c AS (
  SELECT t.conv_id, t.turn, t.text, t.conv_id || '-' || t.turn AS call_id, CASE WHEN role = 'user' THEN (t.conv_id + t.turn) % 12 END AS k,
         CASE WHEN EXISTS (SELECT 1 FROM answered a WHERE a.conv_id = t.conv_id AND a.turn = t.turn) THEN 'answered' ELSE 'pending' END AS status,
         (SELECT count(*) FROM answered a WHERE a.conv_id = t.conv_id AND a.turn + 1 < t.turn) AS before, ring.lead
  FROM t LEFT JOIN ring ON ring.conv_id = t.conv_id WHERE asks
), calls AS (
  SELECT conv_id, turn, call_id, status, CASE WHEN k = 6 THEN 'guess' WHEN k IS NULL THEN 'configure' ELSE 'reply' END AS name,
         CASE WHEN lead IS NULL OR turn <> lead AND before = 0 THEN (2 * before)::INT END AS level,
         CASE WHEN k = 4 THEN '"{\\"text\\""' WHEN k IS NULL OR k = 2 THEN '{"text":' || to_json(text) || '}' WHEN k = 1 THEN '{"n_chars":"' || length(text) || '","text":' || to_json(text) || '}'
              WHEN k = 3 THEN '{"extra":1,"n_chars":' || length(text) || ',"text":' || to_json(text) || '}' WHEN k <> 5 THEN '{"n_chars":' || length(text) || ',"text":' || to_json(text) || '}' END AS arguments,
         CASE k WHEN 1 THEN 'n_chars is not of type integer' WHEN 2 THEN 'n_chars is missing' WHEN 3 THEN 'extra is unexpected' WHEN 4 THEN 'arguments are not a JSON object'
                WHEN 5 THEN 'arguments are not a JSON object' WHEN 6 THEN 'unknown tool' ELSE '' END AS errors
  FROM c
), made AS (
  SELECT * FROM calls UNION ALL
  SELECT conv_id, turn + 1000, call_id, 'duplicate', 'configure', level, '{"text":"again"}', '' FROM calls WHERE name <> 'configure' AND (conv_id + turn) % 11 = 3
), r AS (
  SELECT t.conv_id, t.turn, t.text, t.conv_id || '-' || (t.turn - 1) AS call_id, c.call_id AS own, c.name, CASE WHEN c.call_id IS NULL THEN 0 ELSE c.level + 1 END AS level
  FROM t LEFT JOIN calls c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1 WHERE NOT t.asks
  UNION ALL SELECT conv_id, turn + 1000, text, conv_id || '-lost', NULL, NULL, 0 FROM t WHERE NOT asks AND (conv_id + turn) % 13 = 5
)
SELECT conv_id, turn, 'call' AS kind, call_id, name, status, level, errors = '' AS valid, errors,
       '{' || coalesce('"arguments":' || arguments || ',', '') || '"call_id":"' || call_id || '","conv_id":' || conv_id || ',"errors":[' || CASE errors WHEN '' THEN '' ELSE '"' || errors || '"' END
       || '],"kind":"call",' || coalesce('"level":' || level || ',', '') || '"name":"' || name || '","status":"' || status || '","turn":' || turn || '}' AS json
FROM made
UNION ALL
SELECT conv_id, turn, 'result', call_id, name, CASE WHEN own IS NULL THEN 'orphan' ELSE 'linked' END, level, own IS NOT NULL, '',
       '{"call_id":"' || call_id || '","content":' || to_json(text) || ',"conv_id":' || conv_id || ',"kind":"result",' || coalesce('"level":' || level || ',', '')
       || coalesce('"name":"' || name || '",', '') || '"status":"' || CASE WHEN own IS NULL THEN 'orphan' ELSE 'linked' END || '","turn":' || turn || '}'
FROM r
"""
