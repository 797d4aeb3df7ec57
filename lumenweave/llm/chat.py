"""Chat formatting with tool calls linked to their results, in DataFrame functions only.

A message may hold calls as <tool_call>{"id", "name", "arguments", "after"}</tool_call>; a message of role tool is one
result as {"tool_call_id", "content"}, and other messages may hold <tool_result>{...}</tool_result>. Calls and results
are hash-joined by conversation and identifier, put in an order in which no call stands before what it comes after and
no result before its call, checked against the tools' schemas, and written as canonical JSON (keys sorted, no spaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import prepare, table

#: Tools that calls are checked against by default: name, then parameter to (JSON type, whether it is required).
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "precision": ("integer", False)},
    "lookup": {"key": ("string", True), "options": ("object", False), "tags": ("array", False), "exact": ("boolean", False), "scale": ("number", False)},
}
_CALL, _RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"


def tools_table(spark: SparkSession, tools: dict = TOOLS) -> DataFrame:
    """(name, types: map of parameter to type, required: array of parameters)."""
    rows = [(n, {p: t for p, (t, _) in ps.items()}, sorted(p for p, (_, r) in ps.items() if r)) for n, ps in tools.items()]
    return spark.createDataFrame(rows, "name string, types map<string,string>, required array<string>")


def _type_fits(value: str, type_: str):
    """Whether e.value, a variant whose SQL type is in the SQL text value, is of the JSON type in the SQL text type_.

    A number is an integer by its value, so 1.0 and 1e2 are integers too.
    """
    return (
        f"case {type_} when 'string' then {value} = 'STRING' when 'integer' then {value} = 'BIGINT' or ({value} = 'DOUBLE' or {value} like 'DECIMAL%') and try_variant_get(e.value, '$', 'double') = floor(try_variant_get(e.value, '$', 'double')) "
        f"when 'number' then {value} = 'BIGINT' or {value} = 'DOUBLE' or {value} like 'DECIMAL%' when 'boolean' then {value} = 'BOOLEAN' "
        f"when 'array' then {value} like 'ARRAY%' when 'object' then {value} like 'OBJECT%' when 'null' then {value} = 'VOID' else true end"
    )


#: A string of a JSON text, a number of it, or a stretch of neither.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def canonical(text):
    """JSON without spaces and with sorted keys, with equal numbers written equally.

    Whole numbers below 1e15 have no fraction and no exponent (1.0, 1e0: 1), other decimals no zeros at their end, and
    numbers with an exponent are written as the nearest double. Digits inside strings stay.
    """
    value = lambda x: x.try_cast("double")
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = lambda x: (value(x) == F.floor(value(x))) & (F.abs(value(x)) < 1e15)
    number = lambda x: F.when(x.rlike("^-?[0-9]+$"), F.when(x == "-0", "0").otherwise(x)).when(whole(x), value(x).cast("long").cast("string")).when(x.rlike("[eE]"), value(x).cast("string")).otherwise(plain(x))
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    cut = F.array_join(F.transform(tokens, lambda x: F.when(x.rlike("^-?[0-9]"), number(x)).otherwise(x)), "")
    return F.when(text.rlike(r"[0-9][.eE]|-0"), cut).otherwise(text)


def parts(messages: DataFrame) -> DataFrame:
    """Messages cut into parts: (conv_id, turn, role, part, kind, v, content), kind message, call or result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tool = F.col("role") == "tool"
    rest = F.when(tool, F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(text, _CALL, ""), _RESULT, ""))
    item = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))
    none = F.array().cast("array<string>")
    found = F.concat(
        F.array(F.struct(F.lit("message").alias("kind"), F.lit(None).cast("string").alias("raw"))),
        item("call", F.when(tool | ~F.contains(text, F.lit("<tool_call>")), none).otherwise(F.regexp_extract_all(text, F.lit(_CALL), F.lit(1)))),
        item("result", F.when(tool, F.array(text)).when(F.contains(text, F.lit("<tool_result>")), F.regexp_extract_all(text, F.lit(_RESULT), F.lit(1))).otherwise(none)),
    )
    cut = messages.select("conv_id", "turn", "role", rest.alias("content"), F.posexplode(found).alias("part", "x"))
    cut = cut.where((F.col("x.kind") != "message") | ~F.coalesce(F.col("role") == "tool", F.lit(False)))
    return cut.select("conv_id", "turn", "role", "part", F.col("x.kind").alias("kind"), F.expr("try_parse_json(x.raw)").alias("v"), F.when(F.col("x.kind") == "message", F.col("content")).otherwise(F.col("x.raw")).alias("content"))


def chat_lines(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) to (conv_id, turn, part, kind, call_id, name, status, at_turn, level, json).

    One row for each message, call and result. status: ok; call: invalid (no such tool, a parameter is missing, unknown
    or of another type), broken (not JSON with an id), duplicate (the id is taken by an earlier call), cycle (it comes
    after itself), unanswered; result: unmatched, duplicate or broken. Sorted by (conv_id, at_turn, level, turn, part)
    the rows are in topological order. Null conversations, turns, roles and texts are kept as they are (null text:
    empty); repeated rows stay repeated, of repeated ids the first by (turn, part) counts. An empty table gives no rows.
    Extra columns are not read.
    """
    spark = messages.sparkSession
    prepare(spark)
    rows = parts(messages)
    get = lambda path, kind="string": F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    plain = rows.where("kind = 'message'")
    named = rows.where("kind != 'message'").select("*", F.when(F.col("kind") == "call", get("id")).otherwise(F.coalesce(get("tool_call_id"), get("id"))).alias("call_id")).checkpoint()
    key = ["conv_id", "call_id"]
    place = F.struct("turn", "part")
    whole = named.where("call_id is not null and conv_id is not null")
    first = whole.groupBy(*key, "kind").agg(F.min(place).alias("first"))
    calls_at = first.where("kind = 'call'").select(*key, F.col("first").alias("call_at"))
    results_at = first.where("kind = 'result'").select(*key, F.col("first").alias("result_at"))
    calls = named.where("kind = 'call'").withColumn("name", get("name")).withColumn("args", F.coalesce(get("arguments", "variant"), F.expr("parse_json('{}')")))
    calls = calls.withColumn("given", F.expr("try_variant_get(v, '$.arguments', 'map<string,variant>')"))
    calls = calls.join(tools, "name", "left").join(calls_at, key, "left").join(results_at, key, "left")
    fits = _type_fits("schema_of_variant(e.value)", "element_at(types, e.key)")
    given = "coalesce(given, map())"
    valid = F.expr(f"types is not null and (given is not null or try_variant_get(v, '$.arguments', 'variant') is null) and forall(map_entries({given}), e -> map_contains_key(types, e.key) and ({fits})) and forall(required, p -> map_contains_key({given}, p))")
    calls = calls.withColumn("fits", F.coalesce(valid, F.lit(False)))
    order = call_order(calls.where(place == F.col("call_at")).select(*key, "turn", F.expr("try_variant_get(v, '$.after', 'array<string>')").alias("after")).distinct())
    calls = calls.join(order, key, "left")
    status = (
        F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "broken").when(place != F.col("call_at"), "duplicate").when(F.col("cyclic"), "cycle")
        .when(~F.col("fits"), "invalid").when(F.col("result_at").isNull(), "unanswered").otherwise("ok")
    )
    call_rows = calls.withColumn("status", status).select(
        "conv_id", "turn", "part", "kind", "call_id", "name", "status", F.coalesce("at_turn", "turn").alias("at_turn"), F.coalesce("level", F.lit(0)).alias("level"),
        F.when(F.col("v").isNull(), F.to_json(F.struct(F.col("content"), F.lit("call").alias("type"))))
        .otherwise(canonical(F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type"))))).alias("json"),
    )
    results = named.where("kind = 'result'").join(results_at, key, "left").join(calls_at, key, "left").join(order, key, "left")
    content = F.coalesce(get("content", "variant"), F.expr("to_variant_object(named_struct('text', content))"))
    result_rows = results.select(
        "conv_id", "turn", "part", "kind", "call_id", F.lit(None).cast("string").alias("name"),
        F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "broken").when(F.col("call_at").isNull(), "unmatched").when(place != F.col("result_at"), "duplicate").otherwise("ok").alias("status"),
        F.greatest("turn", "at_turn").alias("at_turn"), (F.coalesce("level", F.lit(0)) + 1).alias("level"),
        canonical(F.to_json(F.struct(content.alias("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")))).alias("json"),
    )
    none = F.lit(None).cast("string")
    plain_rows = plain.select("conv_id", "turn", "part", "kind", none.alias("call_id"), none.alias("name"), F.lit("ok").alias("status"), F.col("turn").alias("at_turn"), F.lit(0).alias("level"), F.to_json(F.struct("content", "role")).alias("json"))
    return plain_rows.unionByName(call_rows).unionByName(result_rows)


#: Calls of a conversation up to which it is ordered in one row; those of more are ordered together, in rounds.
AT_ONCE = 256


def call_order(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, after: array of call ids) to (conv_id, call_id, at_turn, level, cyclic).

    level is the longest chain of calls that a call comes after, and at_turn the latest turn along it; ids that no call
    has are passed over. Calls on a cycle, or after one, are cyclic and keep their own turn. Of repeated calls the least
    turn counts, and the least list of equal turns. Conversations of few calls are ordered each in one row. In the others
    runs of calls that come after one other call only are jumped over, twice as far in each round, so that rounds grow
    with the logarithm of a chain, and with the calls along it that come after several.
    """
    key = ["conv_id", "call_id"]
    own = calls.groupBy(*key).agg(F.min(F.struct(F.col("turn").alias("at_turn"), F.col("after"))).alias("x")).select(*key, "x.*").checkpoint()
    links = own.select(*key, F.explode("after").alias("before")).distinct().join(own.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"])
    linked = links.select("conv_id").distinct()
    free = own.join(linked, "conv_id", "left_anti").select(*key, "at_turn", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    asked = own.join(linked, "conv_id", "left_semi")
    sizes = asked.groupBy("conv_id").agg(F.count("*").alias("n"))
    few, many = (sizes.where(x).select("conv_id") for x in (F.col("n") <= AT_ONCE, F.col("n") > AT_ONCE))
    of = lambda rows, which: rows.join(which, "conv_id", "left_semi")
    return free.unionByName(_ordered_at_once(of(asked, few), of(links, few))).unionByName(_ordered_in_rounds(of(asked, many), of(links, many)))


def _ordered_at_once(calls: DataFrame, links: DataFrame) -> DataFrame:
    """Each conversation's calls as one array in order of turns, passed over until no level or turn changes.

    Calls mostly come after calls before them, so the second pass mostly ends it. On a cycle levels grow in every pass, so
    after as many passes as there are calls they are longer than any chain.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at_turn", "call_id"))
    numbered = calls.select("conv_id", "call_id", "at_turn", place.alias("i"))
    parents = links.join(numbered.select("conv_id", F.col("call_id").alias("before"), "i"), ["conv_id", "before"]).groupBy("conv_id", "call_id").agg(F.collect_list("i").alias("parents"))
    each = numbered.join(parents, ["conv_id", "call_id"], "left").select("conv_id", F.struct("i", "call_id", "at_turn", "parents").alias("c"))
    rows = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("own"))
    kind = "array<struct<level:int,at_turn:bigint>>"
    start = F.transform("own", lambda c: F.struct(F.lit(0).alias("level"), c["at_turn"].cast("long").alias("at_turn"))).cast(kind)

    def passed(before):
        def one(now, c):
            met = F.transform(c["parents"], lambda p: F.coalesce(F.get(now, p - 1), F.get(before, p - 1)))
            most = lambda f: F.array_max(F.transform(met, lambda m: m[f]))
            linked = F.struct((most("level") + 1).alias("level"), F.greatest(c["at_turn"].cast("long"), most("at_turn")).alias("at_turn"))
            alone = F.struct(F.lit(0).alias("level"), c["at_turn"].cast("long").alias("at_turn"))
            return F.array_append(now, F.when(c["parents"].isNull(), alone).otherwise(linked))

        return F.aggregate("own", F.array().cast(kind), one)

    step = lambda s, _: F.when(s["done"], s).otherwise(F.get(F.transform(F.array(passed(s["now"])), lambda x: F.struct(x.alias("now"), (x == s["now"]).alias("done"))), F.lit(0)))
    found = F.aggregate(F.sequence(F.lit(1), F.size("own")), F.struct(start.alias("now"), F.lit(False).alias("done")), step)["now"]
    out = rows.select("conv_id", F.size("own").alias("n"), F.explode(F.arrays_zip(F.col("own"), found.alias("found"))).alias("x"))
    cyclic = F.col("x.found.level") >= F.col("n")  # no chain is as long as there are calls
    return out.select(
        "conv_id", F.col("x.own.call_id").alias("call_id"), F.when(cyclic, F.col("x.own.at_turn")).otherwise(F.col("x.found.at_turn")).alias("at_turn"),
        F.when(cyclic, 0).otherwise(F.col("x.found.level")).alias("level"), cyclic.alias("cyclic"),
    )


def _ordered_in_rounds(calls: DataFrame, links: DataFrame) -> DataFrame:
    key = ["conv_id", "call_id"]
    own = calls.select(*key, "at_turn").checkpoint()
    if not own.limit(1).count():
        return own.select(*key, "at_turn", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    links = links.checkpoint()
    degree = links.groupBy(*key).agg(F.count("*").alias("n"), F.min("before").alias("before"))
    # a call after one other, as (top, far, latest): the call above it that isn't such a one, how far, and the latest turn below that
    jumps = degree.where("n = 1").join(own, key).select(*key, F.col("before").alias("top"), F.lit(1).alias("far"), F.col("at_turn").alias("latest")).checkpoint()
    over = lambda j: j.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("top_"), F.col("far").alias("far_"), F.col("latest").alias("latest_"))
    largest = own.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    reach = 1
    while reach <= largest and jumps.join(over(jumps), ["conv_id", "top"], "left_semi").limit(1).count():
        both = jumps.join(over(jumps), ["conv_id", "top"], "left")
        jumps = both.select(*key, F.coalesce("top_", "top").alias("top"), (F.col("far") + F.coalesce("far_", F.lit(0))).alias("far"), F.greatest("latest", "latest_").alias("latest")).checkpoint()
        reach *= 2
    round_ = over(jumps).select("conv_id", "top")  # what still leads to such a call runs in a circle
    jumps = jumps.join(round_, ["conv_id", "top"], "left_anti").checkpoint()
    core = own.join(degree.where("n = 1"), key, "left_anti")
    several = links.join(degree.where("n > 1").select(*key), key, "left_semi").join(jumps.select("conv_id", F.col("call_id").alias("before"), "top", "far", "latest"), ["conv_id", "before"], "left")
    several = several.select(*key, F.coalesce("top", "before").alias("before"), F.coalesce("far", F.lit(0)).alias("far"), "latest").checkpoint()
    waiting = core.join(several, key, "left_semi").checkpoint()
    done = core.join(several, key, "left_anti").select(*key, "at_turn", F.lit(0).alias("level")).checkpoint()
    while True:
        latest = done.select("conv_id", F.col("call_id").alias("before"), F.col("at_turn").alias("t"), F.col("level").alias("l"))
        ready = several.join(waiting, key).join(latest, ["conv_id", "before"], "left").groupBy(*key).agg(
            F.max(F.greatest("t", "latest", "at_turn")).alias("t"), F.max(F.col("l") + F.col("far")).alias("l"), F.bool_and(F.col("l").isNotNull()).alias("all")
        )
        new = ready.where("all").select(*key, F.col("t").alias("at_turn"), (F.col("l") + 1).alias("level")).checkpoint()
        if not new.limit(1).count():
            break
        done, waiting = done.unionByName(new).checkpoint(), waiting.join(new, key, "left_anti").checkpoint()
    tops = done.select("conv_id", F.col("call_id").alias("top"), F.col("at_turn").alias("t"), "level")
    below = jumps.join(tops, ["conv_id", "top"]).select(*key, F.greatest("t", "latest").alias("at_turn"), (F.col("level") + F.col("far")).alias("level"))
    settled = done.unionByName(below).withColumn("cyclic", F.lit(False))
    rest = own.join(settled, key, "left_anti").select(*key, "at_turn", F.lit(0).alias("level"), F.lit(True).alias("cyclic"))
    return settled.unionByName(rest)


def op4_chat(spark, sf_dir):
    return chat_lines(table(spark, sf_dir, "conversations"), tools_table(spark))


#: Conversations in which every turn also calls a tool, in runs of four calls that come after each other, some of them
#: wrong, and most of them answered; Spark and DuckDB read it alike.
CALLS = """select conv_id, turn * 2 as turn, 'assistant' as role, coalesce(text, '') || '<tool_call>{"name":"' || case when turn % 5 = 3 then 'none' else 'search' end || '","id":"c' || cast(turn as string)
    || '","arguments":{"query":"q' || cast(turn as string) || '","limit":' || cast(turn as string) || case when turn % 2 = 0 then '.0' else '' end || '}' || case when turn % 4 = 0 then '' else ',"after":["c' || cast(turn - 1 as string) || '"]' end || '}</tool_call>' as text
  from conversations where role <> 'tool'
  union all select conv_id, turn * 2 + 1, 'tool', '{"tool_call_id":"c' || cast(turn as string) || '","content":"r' || cast(turn as string) || '"}' from conversations where role <> 'tool' and turn % 3 <> 1"""


def linked_calls(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return chat_lines(spark.sql(CALLS), tools_table(spark))
