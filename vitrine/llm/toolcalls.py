"""Tool calls of conversations: linked to their results, put in order, checked and written as canonical JSON.

Calls (conv_id, call_id, name, arguments, needs) meet results (conv_id, call_id, content) by identifier in a hash join;
``arguments`` is JSON text and ``needs`` lists calls whose results the call uses. A call's level is one above the highest
level of the calls it needs.
Calls on a cycle, or that need an unknown call, have no level and come last.

Arguments are checked against a table of fields (name, field, type, required): unknown tools, broken JSON, missing or
unknown fields and values of the wrong type are named in ``errors``. Canonical JSON has sorted keys, no white space and
no NULL members. Everything runs in Spark's own functions. Turns and calls are numbered by ranges, so that a
conversation of any length is spread over tasks.

Repeated identical calls or results count once. Of different results of one call the least content is linked; each other
one, and each result without a call, is a row of its own with an error. Calls without an identifier are kept, link to
nothing and come last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import cut, in_ranges, positions, reach

#: JSON types by the first character of a value's text.
TYPES = {"string": r'^"', "number": r"^-?[0-9]", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\["}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be placed.

    Most calls need one other call. Such chains are walked by pointer doubling, so that their length costs rounds only in
    its logarithm; calls with several needs are then placed round by round above the heads of the chains they meet.
    """
    key = ["conv_id", "call_id"]
    named = calls.filter(F.col("call_id").isNotNull())
    none = F.array().cast("array<string>")
    needs = cut(
        named.select(*key, F.explode(F.array_distinct(F.coalesce("needs", none))).alias("need")).distinct(), "needs"
    )
    counts = needs.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    start = named.select(*key).distinct().join(counts, key, "left")
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    chain = cut(
        start.select(
            *key,
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(single, F.col("need")).otherwise(F.col("call_id")).alias("at"),
            F.when(single, 1).otherwise(0).alias("far"),
            single.alias("open"),
        ),
        "chain",
    )
    most = chain.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        if chain.filter("open").isEmpty():
            break
        ahead = chain.select(
            "conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"), F.col("open").alias("still")
        )
        step = chain.filter("open").join(ahead, ["conv_id", "at"], "left").select(
            *key, "n", F.col("next").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("still", F.lit(False)).alias("open")
        )
        chain = cut(step.unionByName(chain.filter("not open")), "chain")
    chain = chain.filter("not open and at is not null")  # what is still open runs in a circle
    heads = chain.filter("n = 0").select("conv_id", "call_id", F.lit(0).alias("level"))
    edges = cut(
        needs.join(chain.filter("n > 1").select(*key), key, "left_semi").join(
            chain.select("conv_id", F.col("call_id").alias("need"), F.col("at").alias("head"), "far"), ["conv_id", "need"]
        ),
        "edges",
    )
    waits = chain.filter("n > 1").select(*key, F.col("n").alias("left"), F.lit(0).alias("level"))
    front = heads
    while not edges.isEmpty() and not front.isEmpty():
        met = (
            edges.join(front.select("conv_id", F.col("call_id").alias("head"), F.col("level").alias("base")), ["conv_id", "head"])
            .groupBy(*key)
            .agg(F.count("*").alias("met"), F.max(F.col("base") + F.col("far") + 1).alias("best"))
        )
        waits = cut(
            waits.filter("left > 0").join(met, key, "left").select(
                *key,
                (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"),
                F.greatest("level", F.coalesce("best", F.lit(0))).alias("level"),
            ),
            "waits",
        )
        front = waits.filter("left = 0").select(*key, "level")
        heads = heads.unionByName(front)
    base = heads.select("conv_id", F.col("call_id").alias("at"), F.col("level").alias("base"))
    return chain.join(base, ["conv_id", "at"]).select(*key, (F.col("base") + F.col("far")).alias("level"))


def canonical(value: Column) -> Column:
    """JSON text of a flat object with its keys in order; NULL if the text is no JSON object."""
    pairs = members(value)
    ordered = F.transform(
        F.array_sort(F.map_keys(pairs)),
        lambda k: F.concat(quoted(k), F.lit(":"), member(pairs, k)),
    )
    return F.when(
        is_object(value),
        F.concat(F.lit("{"), F.array_join(F.filter(ordered, lambda x: ~x.endswith(":null")), ","), F.lit("}")),
    )


def quoted(text: Column) -> Column:
    """A JSON string; NULL stays NULL."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(whole, 6, F.length(whole) - 6))


def members(value: Column) -> Column:
    return F.from_json(value, "map<string,variant>")


def is_object(value: Column) -> Column:
    """Whether the text is one JSON object and nothing after it: the parser stops at the end of a value, so the text must
    also be one element of an array."""
    single = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    return F.coalesce(single & F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def member(pairs: Column, key: Column) -> Column:
    """JSON text of one member of an object; objects inside have their keys in order."""
    return F.coalesce(F.to_json(F.try_element_at(pairs, key)), F.lit("null"))


def linked(calls: DataFrame, results: DataFrame, fields: DataFrame) -> DataFrame:
    """(conv_id, position, level, call_id, name, has_result, valid, errors, message): one row per call, and one per result
    that no call takes; ``position`` is the place in the conversation by level and identifier, results last."""
    calls = calls.select("conv_id", "call_id", "name", "arguments", "needs").distinct()
    key = ["conv_id", "call_id"]
    given = results.select(*key, F.coalesce("content", F.lit("")).alias("content"))
    named_results = given.filter("conv_id is not null and call_id is not null")
    content = (F.min("content").alias("content"), F.max("content").alias("most"), F.count("*").alias("n"))
    outcome = cut(named_results.groupBy(*key).agg(*content), "outcome")
    df = calls.withColumn("spare", F.lit(False)).join(outcome.drop("most"), key, "full").join(levels(calls), key, "left")
    df = df.withColumn("spare", F.coalesce("spare", F.lit(True)))
    # Few calls have several results: their other contents are looked up.
    several = outcome.filter("most <> content").select(*key, F.col("content").alias("least"))
    further = named_results.join(several, key).filter("content <> least").select(*given.columns).distinct()
    bare = given.filter("conv_id is null or call_id is null").distinct()
    schema = fields.groupBy("name").agg(
        F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("schema")
    )
    df = df.join(schema, "name", "left")
    pairs = members(F.col("arguments"))
    named = F.map_keys(pairs)
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def check(f: Column) -> Column:
        value = member(pairs, f["field"])
        return F.when(value == "null", F.when(f["required"], F.concat(F.lit("missing "), f["field"]))).when(
            ~F.coalesce(F.rlike(value, F.try_element_at(kinds, f["type"])), F.lit(False)), F.concat(f["field"], F.lit(" is no "), f["type"])
        )

    known_fields = F.transform("schema", lambda f: f["field"])
    unknown = F.transform(F.array_sort(F.array_except(named, known_fields)), lambda k: F.concat(F.lit("unknown "), k))
    errors = (
        F.when(F.col("spare"), F.array(F.lit("result without a call")))
        .when(F.col("schema").isNull(), F.array(F.lit("unknown tool")))
        .when(~is_object(F.col("arguments")), F.array(F.lit("arguments are no JSON object")))
        .otherwise(F.concat(F.filter(F.transform("schema", check), lambda e: e.isNotNull()), unknown))
    )
    df = df.withColumn("errors", errors).withColumn("args", canonical(F.col("arguments")))
    apart = further.withColumn("errors", F.array(F.lit("further result of a call"))).unionByName(
        bare.withColumn("errors", F.array(F.lit("result without a call")))
    )
    apart = apart.withColumn("n", F.lit(1).cast("long")).withColumn("spare", F.lit(True))
    df = df.unionByName(apart, allowMissingColumns=True)
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce("args", quoted(F.col("arguments")), F.lit("{}")),
        F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")),
        F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit("}"),
    )
    order = [F.col("level").asc_nulls_last(), F.col("call_id").asc_nulls_last(), F.col("name").asc(), F.col("arguments").asc(), F.col("needs").asc(), F.col("content").asc()]
    order.insert(0, F.col("spare").asc())
    return positions(df.withColumn("message", message), "conv_id", "position", *order).select(
        "conv_id",
        "position",
        F.col("level").cast("long").alias("level"),
        "call_id",
        "name",
        F.col("n").isNotNull().alias("has_result"),
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        "message",
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and fields that a plain conversation amounts to: each user turn calls ``answer`` with its text
    and needs the call before it; the assistant turn that follows is the result.

    Of different messages of one turn the least stands for it; the others are further calls, told apart by a digest, or
    further results. Messages without conversation or turn are calls and results without identifier. Other roles than user
    and assistant neither call nor answer."""
    reach(turns.sparkSession)
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    keyed = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    bare = turns.filter(F.col("conv_id").isNull() | F.col("turn").isNull())
    message = F.struct("role", "text")
    spoken = keyed.groupBy("conv_id", "turn").agg(F.min(message).alias("m"), F.max(message).alias("most")).select(
        "conv_id", "turn", "m.role", "m.text", (~F.col("m").eqNullSafe(F.col("most"))).alias("several")
    )
    user = F.when(F.col("role") == "user", F.col("turn"))
    ranged = in_ranges(spoken, "conv_id", F.col("turn").asc())
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("conv_id", "part").agg(F.max(user).alias("top"))
    tops = tops.select("conv_id", "part", F.max("top").over(earlier).alias("carried"))
    here = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    line = ranged.withColumn("before", F.max(user).over(here)).join(tops, ["conv_id", "part"])
    line = line.withColumn("before", F.coalesce("before", "carried"))
    line = cut(line.select("conv_id", "turn", "role", "text", "before", "several", F.lit("").alias("mark")), "line")
    main = line.filter("several").select("conv_id", "turn", "before", message.alias("m"))
    line = line.drop("several")
    more = keyed.join(main, ["conv_id", "turn"]).filter(~message.eqNullSafe(F.col("m"))).distinct()
    digest = F.md5(F.to_json(F.struct("role", "text")).cast("binary"))
    more = more.select("conv_id", "turn", "role", "text", "before", F.concat(F.lit("_"), digest).alias("mark"))
    bare = bare.select(
        "conv_id", "turn", "role", "text", F.lit(None).cast("long").alias("before"), F.lit(None).cast("string").alias("mark")
    )
    line = line.unionByName(more).unionByName(bare)
    name_of = lambda turn: F.concat(F.lit("call_"), F.format_string("%06d", turn))
    calls = line.filter("role = 'user'").select(
        "conv_id",
        F.when(F.col("turn").isNotNull(), F.concat(name_of(F.col("turn")), F.col("mark"))).alias("call_id"),
        F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("arguments"),
        F.when(F.col("before").isNotNull(), F.array(name_of(F.col("before")))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    of = F.when(F.col("before").isNotNull(), name_of(F.col("before")))
    results = line.filter("role = 'assistant'").select(
        "conv_id", of.alias("call_id"), F.coalesce("text", F.lit("")).alias("content")
    )
    fields = turns.sparkSession.createDataFrame(
        [("answer", "text", "string", True), ("answer", "turn", "number", True)], "name string, field string, type string, required boolean"
    )
    return cut(calls, "calls"), results, fields
