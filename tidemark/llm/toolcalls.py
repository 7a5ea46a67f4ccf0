"""Tool-call linking for chat formatting, in DataFrame operations only.

Calls (call_id, name, arguments as JSON, after: ids it depends on) and results (call_id, content) are linked by a hash
join on the conversation and the identifier, as identifiers need be unique only within a conversation; rows without a conv_id are one
conversation of their own. Calls are ordered topologically: a call's level is one more than the highest level of the
calls it waits for. In rounds of equality joins waits that a longer way implies go, chains of calls that wait for one other are
shortened to their ends by pointer doubling, and what then waits for known levels only gets its own; what is left when a round
changes nothing waits for itself and has no level. There is no limit on rounds. Arguments are validated against the schema of the tool, and each call is
serialised with its result as canonical JSON: keys sorted, no white space.

call_turns() reads calls from a conversation table. Texts that are JSON objects with tool_calls or tool_call_id are taken as
such. Every other assistant turn is a call of the tool `reply`, with the turn's text as argument, that waits for the reply two turns before; the next turn, if a user's, is its result.

Defined results: null or unparsable arguments, unknown tools, missing, mistyped and unexpected arguments are listed in
errors and never raise; results without a call are left out of the calls and kept by orphan_results(); of several results
of a call the one of the earliest place (then the smallest text) is serialised and all are counted; repeated call ids of a conversation are one
call, the earliest; a dependency on an unknown id is an error and doesn't delay; calls in or behind a cycle have null level; calls and results
of null id can't be linked and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.session import Scratch
from tidemark.session import cut as _cut

#: Tool name -> argument name -> (JSON type, required). Types: string, integer, number, boolean, array, object.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True), "language": ("string", False)}}
#: Waits a call may have for those that a longer way implies to be looked for; it only saves rounds.
FEW_WAITS = 8
#: Places within a turn.
TURN = 1 << 20

_CALL = StructType([StructField("id", StringType()), StructField("name", StringType()), StructField("arguments", StringType()), StructField("after", ArrayType(StringType()))])
_MESSAGE = StructType([StructField("tool_calls", ArrayType(_CALL)), StructField("tool_call_id", StringType()), StructField("content", StringType())])


def cut(df: DataFrame) -> DataFrame:
    """A cut whose columns are new attributes, as the rounds below join a table with what was made of it."""
    done = _cut(df)
    return done.select(*(F.col(c).alias(c) for c in done.columns))


def call_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, place, call_id, name, arguments, after) and results (conv_id, call_id, place, content) of (conv_id, turn, role, text)."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    is_json = F.col("text").rlike(r"(?s)^\s*\{.*\"tool_call")
    parsed = base.withColumn("m", F.when(is_json, F.from_json("text", _MESSAGE)))
    own_id = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    plain = (F.col("role") == "assistant") & F.col("m.tool_calls").isNull()
    arguments = F.to_json(F.struct(F.col("text"), F.col("turn"), words.alias("words")))
    # An id that isn't a call of the table simply finds nothing: only even distances between assistant turns are waited for.
    plain_calls = parsed.where(plain).select("conv_id", (F.col("turn") * TURN).alias("place"), own_id(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(own_id(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"), F.lit(False).alias("declared"))
    json_calls = parsed.where(F.col("m.tool_calls").isNotNull()).select("conv_id", "turn", F.posexplode("m.tool_calls").alias("at", "c")).select("conv_id", (F.col("turn") * TURN + F.col("at")).alias("place"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"), F.lit(True).alias("declared"))
    plain_results = parsed.where((F.col("role") == "user") & F.col("m.tool_call_id").isNull() & (F.col("turn") >= 1)).select("conv_id", own_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
    json_results = parsed.where(F.col("m.tool_call_id").isNotNull()).select("conv_id", F.col("m.tool_call_id").alias("call_id"), F.col("turn").alias("place"), F.col("m.content").alias("content"))
    return plain_calls.unionByName(json_calls), plain_results.unionByName(json_results)


def call_key(call_id: Column) -> Column:
    """A call's identifier with its conversation's, null or not, in one string."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), call_id)


def canonical_json(text: Column) -> Column:
    """Keys sorted, no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """array<string> of what is wrong with a call's arguments under its tool's schema, in a fixed order."""
    value = F.try_parse_json(arguments)
    kinds = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
    no_text = F.lit(None).cast("string")

    def one(tool: str, arg: str, kind: str, required: bool) -> Column:
        got = F.schema_of_variant(F.try_variant_get(value, f"$['{arg}']", "variant"))
        is_null = got.isNull() | (got == "VOID")
        fits = F.regexp_extract(got, r"^[A-Z]+", 0).isin(*kinds[kind]) | ((F.lit(kind == "number")) & got.startswith("DECIMAL"))
        return F.when(is_null, F.lit(f"missing:{arg}") if required else no_text).when(~fits, F.lit(f"type:{arg}"))

    found = F.when(value.isNull(), F.array(F.lit("not_json"))).when(~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("not_object")))
    for tool, args in schemas.items():
        listed = F.array_compact(F.array(no_text, *(one(tool, a, k, r) for a, (k, r) in sorted(args.items()))))
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, args)) if args else F.array().cast("array<string>")))
        found = found.when(name == tool, F.concat(listed, F.transform(extra, lambda k: F.concat(F.lit("unexpected:"), k))))
    return found.otherwise(F.array(F.lit("unknown_tool")))


def _named(df: DataFrame, **names: str) -> DataFrame:
    """The columns named, under the names given."""
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def without_implied(left: DataFrame) -> DataFrame:
    """Waits (call_id, after, steps) but those that a way over another wait of the call implies; a call all of whose waits are so, before a cycle, keeps them."""
    few = left.groupBy("call_id").count().where((F.col("count") > 1) & (F.col("count") <= FEW_WAITS)).select("call_id")
    direct = left.join(few, "call_id")
    over = direct.join(_named(direct, call_id="call_id", via="after", first="steps"), "call_id").where("after <> via")
    last = _named(left, via="call_id", after="after", last="steps")
    implied = over.join(last, ["via", "after"]).where("first + last >= steps").select("call_id", "after").distinct().withColumn("implied", F.lit(True))
    marked = left.join(implied, ["call_id", "after"], "left")
    whole = implied.groupBy("call_id").agg(F.count("*").alias("implied_waits")).join(left.groupBy("call_id").agg(F.count("*").alias("waits")), "call_id").where("implied_waits = waits").select("call_id", F.lit(True).alias("whole"))
    return marked.join(whole, "call_id", "left").where("implied IS NULL OR whole").select("call_id", "after", "steps")


def single_chains(left: DataFrame, floors: DataFrame, scratch: Scratch) -> DataFrame:
    """(call_id, anchor, steps, floor) of calls that wait for one call each: its level is the higher of floor and steps more than the anchor's, the first up the chain that waits for none or several.

    By pointer doubling, so a chain of n calls takes log2(n) rounds. Calls in or behind a cycle of such calls are left out.
    """
    singles = left.groupBy("call_id").agg(F.count("*").alias("n"), F.min("after").alias("anchor"), F.min("steps").alias("steps")).where("n = 1")
    at = scratch.store(singles.join(floors, "call_id", "left").select("call_id", "anchor", "steps", F.coalesce("floor", F.lit(0).cast("long")).alias("floor"), F.lit(True).alias("open")))
    for _ in range(at.count().bit_length() + 1):
        far = at.select(F.col("call_id").alias("via"), F.col("anchor").alias("far"), F.col("steps").alias("more"), F.col("floor").alias("far_floor"))
        joined = at.join(far, F.col("anchor") == F.col("via"), "left")
        floor = F.greatest("floor", F.coalesce(F.col("far_floor") + F.col("steps"), F.lit(0)))
        at = scratch.store(joined.select("call_id", F.coalesce("far", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), floor.alias("floor"), F.col("via").isNotNull().alias("open")))
        if not at.where("open").take(1):
            break
    return scratch.store(at.where("NOT open").drop("open"))


def call_levels(waits: DataFrame, ids: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls that wait for none, else one more than the highest they wait for; calls in or behind cycles are left out.

    waits: (call_id, after), both among ids (call_id).
    """
    with Scratch(ids.sparkSession) as scratch:
        left = scratch.store(waits.select("call_id", "after").distinct().withColumn("steps", F.lit(1).cast("long")))
        levels = scratch.store(ids.join(left, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")))
        floors = scratch.store(levels.select("call_id", F.col("level").alias("floor")).limit(0))
        led, size = [], left.count()
        while size:
            chains = single_chains(left, floors, scratch)
            led.append(chains)
            several = left.join(chains, "call_id", "left_anti")
            # A wait for a chain's call is one for its end and a least level; one for a call of a cycle is kept, so it blocks.
            ends = several.join(_named(chains, after="call_id", anchor="anchor", more="steps", least="floor"), "after", "left")
            ends = scratch.store(ends.select("call_id", F.coalesce("anchor", "after").alias("after"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("steps") + F.col("least")).alias("floor")))
            met = scratch.store(ends.join(_named(levels, after="call_id", level="level"), "after", "left"))
            floors = met.select("call_id", F.greatest("floor", F.col("level") + F.col("steps")).alias("floor")).unionByName(floors.join(several.select("call_id").distinct(), "call_id", "left_semi")).groupBy("call_id").agg(F.max("floor").alias("floor"))
            floors = scratch.store(floors)
            open_ = met.where("level IS NULL").groupBy("call_id", "after").agg(F.max("steps").alias("steps"))
            done = met.groupBy("call_id").agg(F.bool_and(F.col("level").isNotNull()).alias("all_met")).where("all_met").select("call_id")
            levels = scratch.store(levels.unionByName(floors.join(done, "call_id", "left_semi").select("call_id", F.col("floor").alias("level"))))
            left = scratch.store(without_implied(open_))
            now = left.count()
            if now == size and not chains.take(1) and not done.take(1):
                break
            size = now
        for chains in reversed(led):
            through = chains.join(_named(levels, anchor="call_id", level="level"), "anchor").select("call_id", F.greatest("floor", F.col("level") + F.col("steps")).alias("level"))
            levels = scratch.store(levels.unionByName(through))
        return scratch.keep(levels)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """(conv_id, call_id, name, level, n_results, valid, errors, canonical) of every call, ordered by nothing but carrying its level."""
    schemas = SCHEMAS if schemas is None else schemas
    first = F.min(F.struct("place", "conv_id", "name", "arguments", "after", "declared", F.col("call_id").alias("own_id")))
    calls = cut(calls.where("call_id IS NOT NULL").withColumn("key", call_key(F.col("call_id"))).groupBy("key").agg(first.alias("c")).select(F.col("key").alias("call_id"), "c.*"))
    ids = calls.select("call_id")
    wanted = calls.select("call_id", "declared", "conv_id", F.explode(F.array_distinct("after")).alias("id")).withColumn("after", call_key(F.col("id")))
    known = wanted.join(ids.withColumnRenamed("call_id", "after"), "after", "left_semi").select("call_id", "after")
    # A null among the ids waited for is no call's and names none.
    unknown = wanted.where("declared").join(ids.withColumnRenamed("call_id", "after"), "after", "left_anti").groupBy("call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown_id:"), "id"))).alias("lost"))
    levels = call_levels(known, ids)
    answers = results.where("call_id IS NOT NULL")
    if "conv_id" in results.columns:
        answers = answers.withColumn("call_id", call_key(F.col("call_id")))
    else:  # Results of no conversation in particular answer that identifier in each.
        answers = answers.withColumnRenamed("call_id", "own_id").join(calls.select("call_id", "own_id"), "own_id")
    answers = answers.groupBy("call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("place", "content")).alias("r"))
    errors = F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.coalesce("lost", F.array().cast("array<string>")))
    joined = calls.join(answers, "call_id", "left").join(levels, "call_id", "left").join(unknown, "call_id", "left").withColumn("errors", errors)
    # Fields in the order of their names; arguments are JSON already.
    field = lambda k, v: F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null")))
    quoted = lambda c: F.when(c.isNotNull(), F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    text = F.concat(
        F.lit("{"), field("arguments", canonical_json(F.col("arguments"))), F.lit(","), field("id", quoted(F.col("own_id"))), F.lit(","), field("name", quoted(F.col("name"))), F.lit(","), field("result", quoted(F.col("r.content"))), F.lit("}")
    )
    return joined.select(
        "conv_id", F.col("own_id").alias("call_id"), "name", F.col("level").cast("long").alias("level"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), text.alias("canonical")
    )


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier is no call's of their conversation (of any, where results have no conv_id)."""
    if "conv_id" not in results.columns:
        return results.join(calls.select("call_id").distinct(), "call_id", "left_anti")
    known = calls.where("call_id IS NOT NULL").select(call_key(F.col("call_id")).alias("key")).distinct()
    return results.withColumn("key", call_key(F.col("call_id"))).join(known, "key", "left_anti").drop("key")


def tool_digest(conversations: DataFrame) -> DataFrame:
    return link_calls(*call_turns(conversations))


#: tool_digest(conversations) in DuckDB's SQL, for tables without JSON turns.
TOOL_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM m WHERE role = 'assistant'),
r AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM m WHERE role = 'user' AND turn >= 1),
l AS (SELECT conv_id, turn, 0::BIGINT AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
      UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
SELECT c.conv_id, c.conv_id || ':' || c.turn AS call_id, 'reply' AS name, l.level, (r.conv_id IS NOT NULL)::BIGINT AS n_results, true AS valid, '' AS errors,
       '{"arguments":{"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || ',"words":' || c.words || '},"id":"' || c.conv_id || ':' || c.turn || '","name":"reply","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS canonical
FROM c JOIN l USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
"""
