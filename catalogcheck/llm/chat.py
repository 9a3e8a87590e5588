"""Chat formatting with DataFrame functions only: a state machine over roles and a declarative template.

A conversation's rows, ordered by turn (then role and text, so that ties have one order), become segments with a
loss flag each; their texts joined are the formatted conversation. Control strings of the template can't occur
inside a text, because ``ESCAPES`` rewrites every character that could begin one, reversibly. The query reads turns
and trained text back from the formatted string and its loss spans.

Defined results: a null text or role is empty; a role the template doesn't name gets its own escaped header and no
loss; an order of turns that the state machine doesn't accept gives ``valid`` false and is formatted all the same;
rows repeated exactly are turns of their own; rows with a null conversation id form one conversation; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (label in the header, is its text trained on)
ROLES = {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)}
HEAD, MIDDLE, END, OTHER = "### ", ": ", "</turn>\n", "@"
#: Applied in this order; undone in the opposite order.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: (state, role) -> next state; any other role leads to "broken", which nothing leaves.
MOVES = {
    ("start", "system"): "ready",
    ("start", "user"): "asked",
    ("ready", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
FINAL = ("answered", "asked")


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _case(pairs, otherwise: Column) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def header(role: Column) -> Column:
    label = _case([(role == r, F.lit(label)) for r, (label, _) in ROLES.items()], F.concat(F.lit(OTHER), escape(role)))
    return F.concat(F.lit(HEAD), label, F.lit(MIDDLE))


def role_of(label: Column) -> Column:
    return _case([(label == shown, F.lit(r)) for r, (shown, _) in ROLES.items()], unescape(F.substr(label, F.lit(len(OTHER) + 1))))


def trained(role: Column) -> Column:
    return role.isin([r for r, (_, loss) in ROLES.items() if loss])


def final_state(roles: Column) -> Column:
    """The state after a sequence of roles."""

    def step(state, role):
        return _case([((state == s) & (role == r), F.lit(to)) for (s, r), to in MOVES.items()], F.lit("broken"))

    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, state, valid, segments (text, loss), formatted, loss_spans (start, length in code points, from 0)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def parts(t):
        none = F.lit(False)
        return F.array(
            F.struct(header(t["role"]).alias("text"), none.alias("loss")),
            F.struct(escape(t["text"]).alias("text"), trained(t["role"]).alias("loss")),
            F.struct(F.lit(END).alias("text"), none.alias("loss")),
        )

    convs = convs.select(
        "conv_id",
        final_state(F.transform("turns", lambda t: t["role"])).alias("state"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start: int, length: int>>)").alias("spans"))

    def walk(acc, s):
        size = F.length(s["text"])
        here = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct((acc["at"] + size).alias("at"), F.when(s["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return convs.select(
        "conv_id",
        "state",
        F.col("state").isin(list(FINAL)).alias("valid"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.aggregate("segments", start, walk)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the trained text, from the formatted string and its loss spans alone."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p):
        middle = F.instr(p, MIDDLE)
        label = F.substr(p, F.lit(len(HEAD) + 1), middle - len(HEAD) - 1)
        return F.struct(role_of(label).alias("role"), unescape(F.substr(p, middle + len(MIDDLE))).alias("text"))

    texts = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"read_turns": F.transform(pieces, turn), "loss_text": F.array_join(texts, "")})


#: A conversation whose texts hold the template's own control strings.
EXTRA = r"""SELECT cast(-7 AS BIGINT) AS conv_id, cast(t AS BIGINT) AS turn, role,
  concat(chr(92), '### Assistant: </turn> ok') AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, role)"""


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = read_back(format_conversations(turns.unionByName(spark.sql(EXTRA))))
    line = F.lit("\n")
    shown = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return out.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + (length(text) - length(replace(replace(replace(replace(text, chr(92), ''), '#', ''), '<', ''), ':', ''))) AS coded,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 1 + length(role) + (length(role) - length(replace(replace(replace(replace(role, chr(92), ''), '#', ''), '<', ''), ':', ''))) END + 6 AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(head + coded + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user')
    WHEN role = 'user' THEN before = 'assistant' OR (before = 'system' AND k = 2)
    WHEN role = 'assistant' THEN before = 'user' ELSE false END) AND max_by(role, k) IN ('user', 'assistant') AS valid
FROM n GROUP BY conv_id
"""

QUERIES = {"op8_chat_format": op8_chat_format}
ORACLES = {"op8_chat_format": ORACLE}
