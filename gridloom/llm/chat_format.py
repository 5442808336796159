"""Conversations as single texts that can be read back, with the spans that a model learns from.

The turns of a conversation are collected and sorted; adjacent turns of one role become a block, and
blocks are joined by a template's marks. Marks inside texts are escaped: a backslash goes behind the
first character of a mark, or of a mark that already has backslashes there, so that other texts stay
as they are. Everything is a Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base


@dataclass(frozen=True)
class Template:
    """A block is open, role, head, its texts with `next` between them, close."""

    open: str = "<s>"
    head: str = "[INST]"
    next: str = "[/INST]"
    close: str = "</s>"

    def __post_init__(self):
        marks = self.marks
        firsts = {m[:1] for m in marks}
        if len(set(marks)) < len(marks) or min(map(len, marks)) < 2 or any(c in m[1:] or c == "\\" for c in firsts for m in marks) or any("\\" in m for m in marks):
            raise ValueError("marks must differ, have two characters at least and no backslash, and no first character of a mark may be elsewhere in one: their occurrences would overlap")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no mark may begin another one")

    @property
    def marks(self) -> tuple[str, ...]:
        return self.open, self.head, self.next, self.close

    def escaped(self, text: Column) -> Column:
        """The text without any mark in it."""
        return F.regexp_replace(text, "|".join(f"{_quoted(m[0])}(?=\\\\*{_quoted(m[1:])})" for m in self.marks), "$0\\\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, "|".join(f"(?<={_quoted(m[0])})\\\\(?=\\\\*{_quoted(m[1:])})" for m in self.marks), "")


def _quoted(mark: str) -> str:
    return f"\\Q{mark}\\E"


def turns_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns): sorted structs of turn, role, text. Rows without a conversation stand alone, so that they never meet in one group."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")).alias
    named = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), filled(role_col)("role"), filled(text_col)("text")).alias("t"))
    together = named.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return together.unionByName(named.filter("conv_id is null").select("conv_id", F.array("t").alias("turns")))


def formatted(rows: DataFrame, template: Template = Template(), learn: Sequence[str] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): a conversation's text, and (start, length) in code points, from 0, of the texts of roles in `learn`.

    Null roles and texts count as empty. Turns go by number, null ones first, then by role and text;
    rows that repeat a turn all stay. Rows whose conversation is null are a conversation each. An
    empty table has none. A conversation is one value, and so is bounded by what a string may hold
    (2 GB); spans take time with the square of the number of its turns. Other columns are not read.
    """
    e, spans = template.escaped, "array<struct<start: int, length: int>>"
    parts = turns_of(rows, conv_col, turn_col, role_col, text_col).select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: e(t["text"])).alias("texts"))
    # Adjacent turns of one role: where each block begins, then its slice of the texts.
    parts = parts.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("roles") - 1), lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", i - 1))))
    until = lambda k: F.coalesce(F.get("starts", k + 1), F.size("roles"))
    blocks = F.transform("starts", lambda s, k: F.struct(F.get("roles", s).alias("role"), e(F.get("roles", s)).alias("name"), F.slice("texts", s + 1, until(k) - s).alias("texts")))
    merged = parts.select("conv_id", blocks.alias("blocks"))
    joined = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(template.open), b["name"], F.lit(template.head), F.array_join(b["texts"], template.next), F.lit(template.close))), "")

    # The place and the spans so far, over blocks and the texts of each.
    state = lambda at, found: F.struct(at.cast("int").alias("at"), found.alias("found"))

    def block(s: Column, b: Column) -> Column:
        begin = s["at"] + len(template.open) + F.length(b["name"]) + len(template.head)
        span = lambda a, t: F.array(F.struct(a["at"].alias("start"), F.length(t).alias("length")))
        done = F.aggregate(b["texts"], state(begin, s["found"]), lambda a, t: state(a["at"] + F.length(t) + len(template.next), F.when(b["role"].isin(*learn), F.concat(a["found"], span(a, t))).otherwise(a["found"])))
        return state(done["at"] + (len(template.close) - len(template.next)), done["found"])

    found = F.aggregate("blocks", state(F.lit(0), F.array().cast(spans)), block, lambda s: s["found"])
    return merged.select("conv_id", joined.alias("formatted"), found.alias("loss_spans"))


def read_back(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before formatting."""
    u = template.unescaped
    blocks = F.split(text, _quoted(template.close))

    def turns(b: Column) -> Column:
        front = F.substring_index(b, template.head, 1)
        role = u(F.substr(front, F.lit(len(template.open) + 1)))
        return F.transform(F.split(F.substr(b, F.length(front) + len(template.head) + 1), _quoted(template.next)), lambda t: F.struct(role.alias("role"), u(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def learned(text: Column, spans: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: template.unescaped(F.substr(text, s["start"] + 1, s["length"])))


#: A conversation whose texts are made of the template's own marks.
SAMPLE = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), b AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS begins,
    length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS text_chars, length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) AS role_chars
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS learn,
    sum(text_chars + CASE WHEN begins THEN 13 + role_chars ELSE 7 END) AS formatted_chars
  FROM b GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(learn) AS loss_chars, sha256(learn) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = _base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.createDataFrame(SAMPLE, "conv_id long, turn long, role string, text string")
    out = formatted(rows.unionByName(sample))
    back = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), F.array_join(learned(F.col("formatted"), F.col("loss_spans")), "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
