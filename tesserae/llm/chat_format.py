"""Chat formatting with linked tool calls.

A message whose text is a JSON object may hold `tool_calls`, an array of
{id, name, arguments, depends_on}; a message of role `tool` names the call it
answers in `tool_call_id`. Calls and results are joined on (conversation, id).
Arguments are validated against the tools' schemas: given ones, or those that the
conversation defines. A message whose text is a JSON object may hold `tools`, an
array of {name, parameters} or {function: {name, parameters}}, with parameters a JSON
schema of which type, enum, required and additionalProperties are checked, at the top
level; the first definition of a name counts. A conversation with definitions allows no
other tool; without any, arguments must be a JSON object still. Messages are ordered
topologically: a message comes after the calls that it answers or depends on, and
otherwise by turn. Each message becomes one line of canonical JSON: keys sorted,
no blanks between tokens, absent values left out. Keys of a message or call that have
no place of their own are its `extra`, as canonical JSON; those of a message without
content are its content.

Results are rows of messages, ordered by columns (conv_id, anchor, level, turn),
so that a conversation of any length is never gathered in one place. Where all that a
conversation's messages refer to lies in earlier turns, the order of turns is the
topological one, at no cost. Other conversations are placed by rounds, one for each step
of their longest chain of references; what is never placed is a cycle, or waits for one.

Null conversations are one conversation, null turns come first, null roles and
texts are left out of the JSON. Of calls under one id in a conversation, the first
(by turn, then by name and arguments) is linked to and the others are errors. A call without
an id, and a result that names none, link to nothing and are errors. Repeated rows stay
repeated; of equal turns either may come first. Malformed JSON is ordinary text; texts of any
length are kept whole. Further columns are left out, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, stored

#: tool: parameter: (JSON type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]

CALLS = (
    "tool_calls array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>, tool_call_id string, content string, "
    "tools array<struct<name: string, parameters: string, function: struct<name: string, parameters: string>>>"
)
#: Rounds of placement that are kept apart at most.
PARTS = 32
#: What schema_of_variant says of a JSON type.
TYPES = {
    "integer": "^(BIGINT|DECIMAL[(][0-9]+,0[)])$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*$",
    "object": "^OBJECT<.*$",
}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; null if malformed. A variant keeps the keys of objects in order."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments: an array of texts, empty if nothing is. Unknown tools are errors."""
    value = F.try_parse_json(F.coalesce(arguments, F.lit("{}")))
    is_object = F.schema_of_variant(value).rlike("^OBJECT<")
    no = F.array().cast("array<string>")
    found = F.array(F.lit("unknown tool"))
    for tool, parameters in sorted(schemas.items()):
        keys = F.coalesce(F.json_object_keys(arguments), no)
        checks = [F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(parameters))).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))]
        for p, (kind, required) in sorted(parameters.items()):
            kind_of = F.schema_of_variant(F.try_variant_get(value, f"$.{p}", "variant"))
            absent = ~F.array_contains(keys, p)
            wrong = F.when(absent, F.lit(f"missing {p}") if required else F.lit(None)).when(~kind_of.rlike(TYPES[kind]), F.lit(f"{p} is no {kind}"))
            checks.append(F.array_compact(F.array(wrong)))
        found = F.when(name == tool, F.when(F.coalesce(is_object, F.lit(False)), F.concat(*checks)).otherwise(F.array(F.lit("arguments are no object")))).otherwise(found)
    return found


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike("^OBJECT<"), F.lit(False))


def defined_tools(rows: DataFrame) -> DataFrame:
    """no_conv, conv, name, parameters (JSON) of the tools that conversations define."""
    each = rows.where("body.tools IS NOT NULL").select("no_conv", "conv", "turn", "row_no", F.posexplode("body.tools").alias("at", "t"))
    each = each.select("no_conv", "conv", F.coalesce("t.name", "t.function.name").alias("name"), F.struct("turn", "row_no", "at").alias("place"), F.coalesce("t.parameters", "t.function.parameters").alias("p"))
    return each.where("name IS NOT NULL").groupBy("no_conv", "conv", "name").agg(F.min_by("p", "place").alias("parameters"))


def defined_errors(arguments: Column, parameters: Column) -> Column:
    """What is wrong with a call's arguments by a tool's own JSON schema."""
    text = F.coalesce(arguments, F.lit("{}"))
    value = F.try_parse_json(text)
    given = F.try_variant_get(value, "$", "map<string,variant>")
    plain = F.from_json(text, "map<string,string>")
    keys = F.coalesce(F.map_keys(given), F.array().cast("array<string>"))
    schema = F.from_json(parameters, "properties map<string,struct<type: string, enum: array<string>>>, required array<string>, additionalProperties string")
    known = F.coalesce(F.map_keys(schema["properties"]), F.array().cast("array<string>"))
    patterns = F.create_map(*(F.lit(x) for pair in [*TYPES.items(), ("null", "^VOID$")] for x in pair))

    def wrong(p: Column) -> Column:
        kind, allowed = schema["properties"][p]["type"], schema["properties"][p]["enum"]
        kinds = F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
        found = F.schema_of_variant(given[p])
        fits = F.exists(kinds, lambda k: F.coalesce(F.rlike(found, patterns[k]), F.lit(True)))  # a type we don't know allows anything
        return F.when(~fits, F.concat(p, F.lit(" is no "), F.array_join(kinds, " or "))).when(~F.array_contains(allowed, plain[p]), F.concat(p, F.lit(" is none of its values")))

    none = F.array().cast("array<string>")
    missing = F.transform(F.coalesce(F.array_except(schema["required"], keys), none), lambda p: F.concat(F.lit("missing "), p))
    extra = F.transform(F.when(schema["additionalProperties"] == "false", F.array_except(keys, known)).otherwise(none), lambda p: F.concat(F.lit("unknown "), p))
    return F.when(_is_object(value), F.concat(missing, extra, F.array_compact(F.transform(F.array_intersect(known, keys), wrong)))).otherwise(F.array(F.lit("arguments are no object")))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    body = F.when(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(text, CALLS))
    return messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        text.alias("text"),
        body.alias("body"),
    )


def _site(df: DataFrame) -> DataFrame:
    """The conversation as two columns that are never null, to join on."""
    return df.withColumn("no_conv", F.col("conv_id").isNull()).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


KEY = ["no_conv", "conv", "id"]


def format_chats(
    messages: DataFrame,
    schemas: Schemas | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    max_rounds: int | None = None,
) -> DataFrame:
    """conv_id, turn, role, anchor, level, n_calls, n_errors, linked, json of every message.

    schemas: None takes those that each conversation defines. linked: of a tool's result, whether its call was found.
    max_rounds: None goes on for as long as messages are placed; else more rounds than that are an error.
    """
    rows = _site(parsed(messages, conv_col, turn_col, role_col, text_col)).withColumn("row_no", F.monotonically_increasing_id())
    plain_only = rows.where("body.tool_calls IS NOT NULL OR role = 'tool'").isEmpty()
    if plain_only:
        return _lines(rows.select("*", F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("boolean").alias("linked")))
    rows = stored(rows, "chat-messages")
    no = F.array().cast("array<string>")
    calls = rows.select("no_conv", "conv", "row_no", "turn", F.posexplode("body.tool_calls").alias("at", "call"))
    calls = calls.select("no_conv", "conv", "row_no", "turn", "at", "call.id", "call.name", "call.arguments", "call.depends_on")
    first = calls.where("id IS NOT NULL").groupBy(*KEY).agg(F.min_by(F.struct("row_no", "turn"), F.struct("turn", "name", "arguments", "row_no")).alias("owner"), F.count("*").alias("n"))
    if schemas is not None:
        wrong = argument_errors(F.col("name"), F.col("arguments"), schemas)
    else:
        tools = defined_tools(rows)
        calls = calls.join(tools.withColumn("known", F.lit(True)), ["no_conv", "conv", "name"], "left")
        calls = calls.join(tools.select("no_conv", "conv").distinct().withColumn("strict", F.lit(True)), ["no_conv", "conv"], "left")
        wrong = F.when(F.col("strict") & F.col("known").isNull(), F.array(F.lit("unknown tool"))).otherwise(defined_errors(F.col("arguments"), F.col("parameters")))
    errors = calls.select("row_no", F.concat(wrong, F.when(F.col("id").isNull(), F.array(F.lit("no id"))).otherwise(no)).alias("e"))
    several = calls.join(first.where("n > 1"), KEY).where(F.col("owner.row_no") != F.col("row_no"))
    errors = errors.unionByName(several.select("row_no", F.array(F.concat(F.lit("repeated id "), F.col("id"))).alias("e")))
    needs = calls.select("no_conv", "conv", "row_no", "turn", F.explode("depends_on").alias("id"), F.lit(False).alias("answer"))
    answers = rows.where("role = 'tool'").select("no_conv", "conv", "row_no", "turn", F.col("body.tool_call_id").alias("id"), F.lit(True).alias("answer"))
    refs = stored(needs.unionByName(answers).join(first.select(*KEY, "owner"), KEY, "left"), "chat-references")
    errors = errors.unionByName(refs.where("owner IS NULL").select("row_no", F.array(F.concat(F.lit("no call "), F.coalesce("id", F.lit("")))).alias("e")))
    linked = refs.where("answer").select("row_no", F.col("owner").isNotNull().alias("linked"))
    # A message whose owner isn't of an earlier turn puts its conversation out of order.
    refs = refs.where("owner IS NOT NULL AND owner.row_no != row_no").select("no_conv", "conv", "row_no", "turn", F.col("owner.row_no").alias("owner"), F.col("owner.turn").alias("owner_turn"))
    late = refs.where(~F.coalesce((F.col("owner_turn") < F.col("turn")) | (F.col("owner_turn").isNull() & F.col("turn").isNotNull()), F.lit(False))).select("no_conv", "conv").distinct()
    refs = refs.join(late, ["no_conv", "conv"], "left_semi").select("row_no", "owner").distinct()
    order = _order(rows.select("row_no", "turn"), refs, max_rounds)
    blank = {"e": no, "linked": F.lit(None).cast("boolean"), "place": F.lit(None).cast("struct<anchor: bigint, level: int, cyclic: boolean>")}
    fill = lambda df, **own: df.select("row_no", *(own.get(k, v).alias(k) for k, v in blank.items()))
    found = fill(errors, e=F.col("e")).unionByName(fill(linked, linked=F.col("linked"))).unionByName(fill(order, place=F.struct("anchor", "level", "cyclic")))
    found = found.groupBy("row_no").agg(F.flatten(F.collect_list("e")).alias("errors"), F.bool_and("linked").alias("linked"), F.any_value("place", ignoreNulls=True).alias("place"))
    done = rows.join(found, "row_no", "left")
    own = F.coalesce("errors", no)
    return _lines(
        done.withColumn("errors", F.array_sort(F.when(F.coalesce("place.cyclic", F.lit(False)), F.concat(own, F.array(F.lit("cycle")))).otherwise(own)))
        .withColumn("anchor", F.coalesce("place.anchor", "turn"))
        .withColumn("level", F.coalesce("place.level", F.lit(0)))
    )


def _order(turns: DataFrame, refs: DataFrame, max_rounds: int | None) -> DataFrame:
    """row_no, anchor, level, cyclic of the messages that refer to others.

    A message is placed once all it refers to are: its anchor is the latest of its turn and their anchors,
    and within one anchor its level is above theirs. A round for each step of the longest chain.
    """
    waiting = checkpointed(refs)
    if waiting.isEmpty():
        return turns.select("row_no", F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(False).alias("cyclic")).limit(0)
    targets = waiting.select(F.col("owner").alias("row_no")).distinct().join(waiting.select("row_no").distinct(), "row_no", "left_anti")
    placed = checkpointed(targets.join(turns, "row_no").select("row_no", F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(False).alias("cyclic")))
    result = [placed]
    fresh = placed
    met = None
    for round_no in count():
        step = waiting.join(fresh.select(F.col("row_no").alias("owner"), "anchor", "level"), "owner")
        met = checkpointed(step if met is None else met.unionByName(step))
        left = waiting.groupBy("row_no").agg(F.count("*").alias("n"))
        ready = met.groupBy("row_no").agg(F.count("*").alias("m"), F.max("anchor").alias("latest"), F.max(F.struct("anchor", "level")).alias("top")).join(left, "row_no").where("m = n")
        ready = ready.join(turns, "row_no")
        later = F.coalesce(F.col("turn") > F.col("latest"), F.col("latest").isNull() & F.col("turn").isNotNull())
        fresh = checkpointed(ready.select("row_no", F.when(later, F.col("turn")).otherwise(F.col("latest")).alias("anchor"), F.when(later, F.lit(0)).otherwise(F.col("top.level") + 1).alias("level"), F.lit(False).alias("cyclic")))
        if fresh.isEmpty():
            break
        if max_rounds is not None and round_no >= max_rounds:
            raise RuntimeError(f"messages not placed in {max_rounds} rounds")
        result.append(fresh)
        if len(result) == PARTS:  # a long chain's plan must not grow with it
            result = [checkpointed(reduce(DataFrame.unionByName, result))]
        waiting = checkpointed(waiting.join(fresh.select("row_no"), "row_no", "left_anti"))
        met = checkpointed(met.join(fresh.select("row_no"), "row_no", "left_anti"))
    rest = waiting.select("row_no").distinct().join(turns, "row_no").select("row_no", F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(True).alias("cyclic"))
    return reduce(DataFrame.unionByName, [*result, rest])


def _rest(members: Column, carried: Column) -> Column:
    """Canonical JSON of an object (a map of variants) less some keys; null if nothing is left."""
    left = F.map_filter(members, lambda k, _: ~F.array_contains(carried, k))
    return F.when(F.size(left) > 0, F.to_json(F.to_variant_object(left)))


def _keys(always: list[str], **if_read: Column) -> Column:
    """Names of keys that are written elsewhere; those of if_read only if their values could be read."""
    return F.array_compact(F.array(*map(F.lit, always), *(F.when(read, F.lit(k)) for k, read in if_read.items())))


def _lines(rows: DataFrame) -> DataFrame:
    # Only lines with a body are parsed again.
    whole = F.try_parse_json(F.when(F.col("body").isNotNull(), F.col("text")))
    members = F.try_variant_get(whole, "$", "map<string,variant>")
    as_given = F.try_variant_get(whole, "$.tool_calls", "array<map<string,variant>>")
    calls = F.transform(
        "body.tool_calls",
        lambda c, i: F.struct(
            F.coalesce(canonical(c["arguments"]), c["arguments"]).alias("arguments"),
            c["depends_on"].alias("depends_on"),
            _rest(F.get(as_given, i), _keys(["arguments", "id", "name"], depends_on=c["depends_on"].isNotNull())).alias("extra"),
            c["id"].alias("id"),
            c["name"].alias("name"),
        ),
    )
    rest = _rest(members, _keys(["content"], tool_call_id=F.col("body.tool_call_id").isNotNull(), tool_calls=F.col("body.tool_calls").isNotNull() & as_given.isNotNull()))
    has_content = F.coalesce(F.array_contains(F.map_keys(members), "content"), F.lit(False))
    special = F.col("body.tool_calls").isNotNull() | F.coalesce(F.col("role") == "tool", F.lit(False)) & F.col("body").isNotNull()
    line = F.struct(
        F.when(~special, F.col("text")).when(has_content, F.col("body.content")).otherwise(rest).alias("content"),
        F.col("conv_id"),
        F.when(F.size("errors") > 0, F.col("errors")).alias("errors"),
        F.when(special & has_content, rest).alias("extra"),
        F.col("role"),
        F.when(special, F.col("body.tool_call_id")).alias("tool_call_id"),
        calls.alias("tool_calls"),
        F.col("turn"),
    )
    return rows.select(
        "conv_id", "turn", "role", "anchor", "level",
        F.greatest(F.coalesce(F.size("body.tool_calls"), F.lit(0)), F.lit(0)).cast("long").alias("n_calls"),
        F.size("errors").cast("long").alias("n_errors"),
        "linked",
        F.to_json(line).alias("json"),
    )


#: Tools of the registered query.
TOOLS: Schemas = {"search": {"query": ("string", True), "limit": ("integer", False)}, "count": {"n": ("integer", True), "exact": ("boolean", False)}}


def with_calls(messages: DataFrame) -> DataFrame:
    """The conversations with tool calls, which the given tables lack: each assistant's message calls a tool, and a result answers it.

    Calls depend on earlier ones in chains of four, in some conversations on later ones too, or in cycles. Some name unknown
    tools, have arguments that don't fit, or are answered under another id or before they are made. Turns are numbered by fours.
    """
    k = F.floor(F.col("turn") / 2).cast("long")
    pick = lambda m, r, of=k + F.col("conv_id"): F.pmod(of, F.lit(m)) == r
    name = F.when(pick(11, 10), F.lit("lookup")).when(pick(3, 1), F.lit("count")).otherwise(F.lit("search"))
    n = F.length("text").cast("long")
    search = F.struct(
        F.when(~pick(7, 5), F.substring("text", 1, 20)).alias("query"),
        F.when(pick(7, 3), F.to_variant_object(F.array(F.lit("many")))).otherwise(n.cast("variant")).alias("limit"),
        F.when(pick(7, 6), F.lit(True)).alias("x"),
    )
    arguments = F.when(name == "count", F.to_json(F.struct(pick(5, 2).alias("exact"), n.alias("n")))).otherwise(F.to_json(search))
    id_ = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    cyclic = F.pmod("conv_id", F.lit(17)) == 3
    needs = F.when(~pick(4, 0, k), F.array(id_(F.col("turn") - 2))).when(cyclic, F.array(id_(F.col("turn") + 2)))
    call = F.struct(F.from_json(arguments, "variant").alias("arguments"), needs.alias("depends_on"), id_(F.col("turn")).alias("id"), name.alias("name"))
    asked = F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")))
    early = (F.pmod("conv_id", F.lit(5)) == 4) & pick(3, 1, k)
    answer = F.to_json(F.struct(F.concat(F.lit("result "), n.cast("string")).alias("content"), F.when(pick(13, 12), F.lit("none")).otherwise(id_(F.col("turn"))).alias("tool_call_id")))
    is_call = F.col("role") == "assistant"
    first = F.struct((F.col("turn") * 4).alias("turn"), "role", F.when(is_call, asked).otherwise(F.col("text")).alias("text"))
    second = F.struct((F.col("turn") * 4 + F.when(early, -1).otherwise(1)).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return messages.select("conv_id", F.explode(F.when(is_call, F.array(first, second)).otherwise(F.array(first))).alias("m")).select("conv_id", "m.*")


def query(spark, sf_dir):
    out = format_chats(with_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
    return out.select("conv_id", "turn", "role", "anchor", F.col("level").cast("long").alias("level"), "n_calls", "n_errors", "linked", "json")


#: with_calls() and the query's rows by definition: ancestors by recursion, cycles as nodes above themselves, levels as longest paths.
SQL = r"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn AS t, role, text, turn // 2 AS k, turn // 2 + conv_id AS j, length(text) AS n FROM conversations),
  a AS (SELECT *, CASE WHEN j % 11 = 10 THEN 'lookup' WHEN j % 3 = 1 THEN 'count' ELSE 'search' END AS name FROM m WHERE role = 'assistant'),
  c AS (SELECT *, 'c' || t AS id, CASE WHEN k % 4 <> 0 THEN 'c' || (t - 2) WHEN conv_id % 17 = 3 THEN 'c' || (t + 2) END AS need,
    CASE WHEN name = 'count' THEN '{"exact":' || (j % 5 = 2) || ',"n":' || n || '}'
      ELSE '{"limit":' || CASE WHEN j % 7 = 3 THEN '["many"]' ELSE CAST(n AS VARCHAR) END || CASE WHEN j % 7 <> 5 THEN ',"query":' || CAST(to_json(substring(text, 1, 20)) AS VARCHAR) ELSE '' END
        || CASE WHEN j % 7 = 6 THEN ',"x":true' ELSE '' END || '}' END AS args,
    CASE WHEN name = 'lookup' THEN ['unknown tool'] WHEN name = 'count' THEN CAST([] AS VARCHAR[])
      ELSE list_filter([CASE WHEN j % 7 = 3 THEN 'limit is no integer' END, CASE WHEN j % 7 = 5 THEN 'missing query' END, CASE WHEN j % 7 = 6 THEN 'unknown x' END], lambda x: x IS NOT NULL) END AS wrong
    FROM a),
  nodes AS (SELECT conv_id, 2 * r AS v, 4 * t AS turn, role, text AS content, CAST(NULL AS VARCHAR) AS tool_call_id, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS args, CAST(NULL AS VARCHAR) AS need, CAST([] AS VARCHAR[]) AS wrong FROM m WHERE role <> 'assistant'
    UNION ALL SELECT conv_id, 2 * r, 4 * t, role, text, NULL, id, name, args, need, wrong FROM c
    UNION ALL SELECT conv_id, 2 * r + 1, 4 * t + CASE WHEN conv_id % 5 = 4 AND k % 3 = 1 THEN -1 ELSE 1 END, 'tool', 'result ' || n, CASE WHEN j % 13 = 12 THEN 'none' ELSE id END, NULL, NULL, NULL, NULL, CAST([] AS VARCHAR[]) FROM c),
  refs AS (SELECT x.conv_id, x.v, x.tool_call_id IS NOT NULL AS answer, coalesce(x.need, x.tool_call_id) AS wanted, y.v AS u FROM nodes x LEFT JOIN nodes y ON y.conv_id = x.conv_id AND y.id = coalesce(x.need, x.tool_call_id)
    WHERE x.need IS NOT NULL OR x.tool_call_id IS NOT NULL),
  e AS (SELECT v, u FROM refs WHERE u IS NOT NULL AND u <> v),
  up(v, u) AS (SELECT v, u FROM e UNION SELECT up.v, e.u FROM up JOIN e ON e.v = up.u),
  loops AS (SELECT v FROM up WHERE v = u),
  stuck AS (SELECT v FROM loops UNION SELECT up.v FROM up JOIN loops ON loops.v = up.u),
  anchors AS (SELECT x.v, greatest(x.turn, max(y.turn)) AS anchor FROM nodes x JOIN up ON up.v = x.v JOIN nodes y ON y.v = up.u WHERE x.v NOT IN (SELECT v FROM stuck) GROUP BY x.v, x.turn),
  placed AS (SELECT nodes.*, stuck.v IS NOT NULL AS cyclic, coalesce(anchors.anchor, nodes.turn) AS anchor FROM nodes LEFT JOIN anchors USING (v) LEFT JOIN stuck ON stuck.v = nodes.v),
  same AS (SELECT e.v, e.u FROM e JOIN placed x ON x.v = e.v JOIN placed y ON y.v = e.u WHERE x.anchor = y.anchor AND NOT x.cyclic),
  depth(v, n) AS (SELECT v, 1 FROM same UNION SELECT same.v, depth.n + 1 FROM depth JOIN same ON same.u = depth.v),
  levels AS (SELECT v, max(n) AS level FROM depth GROUP BY 1),
  judged AS (SELECT p.*, coalesce(l.level, 0) AS level, refs.u IS NOT NULL AS found, refs.answer,
    list_sort(p.wrong || CASE WHEN refs.v IS NOT NULL AND refs.u IS NULL THEN ['no call ' || refs.wanted] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN p.cyclic THEN ['cycle'] ELSE CAST([] AS VARCHAR[]) END) AS errors
    FROM placed p LEFT JOIN levels l USING (v) LEFT JOIN refs ON refs.v = p.v)
SELECT conv_id, turn, role, anchor, CAST(level AS BIGINT) AS level, CAST(id IS NOT NULL AS BIGINT) AS n_calls, CAST(len(errors) AS BIGINT) AS n_errors, CASE WHEN answer THEN found END AS linked,
  '{' || concat_ws(',', '"content":' || CAST(to_json(content) AS VARCHAR), '"conv_id":' || conv_id, CASE WHEN len(errors) > 0 THEN '"errors":' || CAST(to_json(errors) AS VARCHAR) END, '"role":"' || role || '"',
    '"tool_call_id":' || CAST(to_json(tool_call_id) AS VARCHAR),
    CASE WHEN id IS NOT NULL THEN '"tool_calls":[{' || concat_ws(',', '"arguments":' || CAST(to_json(args) AS VARCHAR), '"depends_on":["' || need || '"]', '"id":"' || id || '"', '"name":"' || name || '"') || '}]' END,
    '"turn":' || turn) || '}' AS json
FROM judged"""
