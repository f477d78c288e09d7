"""Chat formatting: a state machine over roles, a declarative template, segments with loss flags.

The template names for each role the control strings around its texts and whether its texts are
trained on; ``NEXT`` lists the roles that may follow a role. Inside texts, a backslash is doubled and
a control string gets a backslash after its first character, so no text can close or open a turn, and
taking each backslash away again gives the text back.

Turns are ordered by turn (null first), then role, then text. Null texts are empty, null roles are
the role ''; roles without a template entry are written with their name. Repeated rows are turns of
their own. A null conv_id is one conversation. Other columns are ignored. Conversations out of order
are formatted all the same, with ``valid`` false.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import table

TEMPLATE = {
    "system": {"open": "<<SYS>> ", "close": " <</SYS>>", "loss": False},
    "user": {"open": "[INST] ", "close": " [/INST]", "loss": False},
    "assistant": {"open": "<s> ", "close": " </s>", "loss": True},
}
#: Around a role that the template doesn't have, and its text.
OTHER = {"open": "<<ROLE>> ", "middle": " <<TEXT>> ", "close": " <</ROLE>>"}
#: The machine: '^' is its start; conversations end well in END.
NEXT = {"^": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
END = ("assistant",)


def controls(template: dict) -> list[str]:
    found = sorted({v.strip() for r in (*template.values(), OTHER) for k, v in r.items() if k != "loss"}, key=len, reverse=True)
    for a in found:
        for b in found:
            if any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError(f"control strings may not run into each other: {a} {b}")
    return found


def escape(text, template: dict = TEMPLATE):
    marks = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in controls(template))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), marks, "\\\\")


def unescape(text):
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def segments(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """A row for each turn: conv_id, n (from 1), role, valid (it may follow the turn before it), parts.

    ``parts`` is an array of (text, loss): what opens the turn, its escaped text, what closes it.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    allowed = F.lit(False)
    before = F.coalesce(F.lag("role").over(w), F.lit("^"))
    for state, following in NEXT.items():
        allowed = allowed | ((before == state) & F.col("role").isin(*following))
    part = lambda c, loss=False: F.struct(c.alias("text"), F.lit(loss).alias("loss"))
    body = escape(F.col("text"), template)
    opened = F.concat(F.lit(OTHER["open"]), escape(F.col("role"), template), F.lit(OTHER["middle"]))
    parts = F.array(part(opened), part(body), part(F.lit(OTHER["close"])))
    for name, r in template.items():
        parts = F.when(F.col("role") == name, F.array(part(F.lit(r["open"])), part(body, r["loss"]), part(F.lit(r["close"])))).otherwise(parts)
    return rows.select("conv_id", F.row_number().over(w).alias("n"), "role", allowed.alias("valid"), parts.alias("parts"))


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, formatted, parts (text, loss) in order, valid. A conversation is one row, as large as its texts."""
    made = segments(turns, template).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "parts"))).alias("turns"), F.bool_and("valid").alias("valid"), F.max_by("role", "n").alias("last")
    )
    parts = F.flatten("turns.parts")
    return made.select("conv_id", F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("formatted"), parts.alias("parts"), (F.col("valid") & F.col("last").isin(*END)).alias("valid"))


def read_back(formatted, template: dict = TEMPLATE):
    """The turns (role, text) of a formatted conversation, from its string alone."""
    shapes = [(name, r["open"], r["close"]) for name, r in template.items()]
    between = lambda o, c: f"{re.escape(o)}.*?{re.escape(c)}"
    pattern = "(?s)" + "|".join([between(o, c) for _, o, c in shapes] + [between(OTHER["open"], OTHER["close"])])

    def turn(x):
        inner = lambda o, c: F.substring(x, F.lit(len(o) + 1), F.length(x) - len(o) - len(c))
        rest = inner(OTHER["open"], OTHER["close"])
        at = F.instr(rest, OTHER["middle"])
        role = F.substring(rest, F.lit(1), at - 1)
        text = F.substring(rest, at + len(OTHER["middle"]), F.length(rest))
        for name, o, c in shapes:
            role = F.when(x.startswith(o), F.lit(name)).otherwise(role)
            text = F.when(x.startswith(o), inner(o, c)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def op5_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    made = format_conversations(turns).withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _sql() -> str:
    """The same rows from SQL alone: texts as they are, lengths by counting what the template adds."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marks = " + ".join(f"(length(s) - length(replace(s, {quoted(c)}, ''))) // {len(c)}" for c in controls(TEMPLATE))
    grown = lambda c: f"(select length(s) + length(s) - length(replace(s, '\\', '')) + {marks} from (select {c} as s))"
    frame = " ".join(f"when role = {quoted(n)} then {len(r['open']) + len(r['close'])}" for n, r in TEMPLATE.items())
    other = sum(map(len, OTHER.values()))
    follows = " or ".join(f"(before = {quoted(s)} and role in ({', '.join(map(quoted, r))}))" for s, r in NEXT.items())
    said = quoted("</s>[INST] ok [/INST]")
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', {said} union all select -1, 1, 'assistant', {said}
), o as (
  select *, row_number() over w as n, coalesce(lag(role) over w, '^') as before from t
  window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum({grown('text')} + case {frame} else {other} + {grown('role')} end)::bigint as formatted_chars,
  bool_and({follows}) and arg_max(role, n) in ({', '.join(map(quoted, END))}) as valid
from o group by conv_id"""


QUERIES = {"op5_chat": op5_chat}
SQL = {"op5_chat": _sql()}
