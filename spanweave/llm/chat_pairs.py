"""Preference formatting: one prompt and two masked completions for each pair.

The longest common prefix of turns (equal role and text) of the chosen and the
rejected conversation is rendered once as the prompt; what follows is rendered
as two completions. A completion's spans are the character ranges of its
assistant turns' texts, the only parts that bear loss.

Defined cases: turns are ordered by (turn, role, text), null turn numbers
first; null roles and texts are ''; turns that repeat are kept; a side that is
only the common prefix gets an empty completion; a pair that is equal on both
sides has two empty completions and is not usable; a null side is rendered as an
empty one and its pair is not usable; empty turn tables give an empty table;
other columns of the input are ignored. Conversations with a null id are one
conversation. Turns of any length are rendered whole, and roles and texts as they
are: what looks like a turn's head inside a text is not escaped, and spans, which
count characters, still tell it from a head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def turn_lists(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array of (role, text)."""
    t = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    lists = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit("\n"))), "")


def _spans(turns: Column) -> Column:
    """Ranges of trained text, as 'start-end' joined by commas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t["role"]))
        end = begin + F.length(t["text"])
        said = F.concat(acc["spans"], F.when(acc["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when((t["role"] == TRAINED_ROLE) & (F.length(t["text"]) > 0), said).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """From (pair_id, chosen, rejected) with arrays of (role, text) to one training row for each pair."""
    whole = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    sides = [F.coalesce(s, F.array().cast(pairs.schema[s].dataType)).alias(s) for s in ("chosen", "rejected")]
    pairs = pairs.select("pair_id", *sides, whole.alias("whole"))
    c, r = F.col("chosen"), F.col("rejected")
    both = F.least(F.size(c), F.size(r))
    same = F.when(both > 0, F.transform(F.sequence(F.lit(1), both), lambda i: F.element_at(c, i).eqNullSafe(F.element_at(r, i)))).otherwise(F.array().cast("array<boolean>"))
    found = F.array_position(same, False)
    at = pairs.select("pair_id", "chosen", "rejected", "whole", F.when(found > 0, found - 1).otherwise(both).cast("int").alias("k"))
    rest = at.select("pair_id", "k", "whole", F.slice("chosen", F.lit(1), F.col("k")).alias("p"), *[F.slice(s, F.col("k") + 1, F.size(s)).alias(s) for s in ("chosen", "rejected")])
    return rest.select(
        "pair_id",
        F.col("k").cast("long").alias("n_prompt_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("chosen")).alias("chosen"),
        _spans(F.col("chosen")).alias("chosen_spans"),
        _render(F.col("rejected")).alias("rejected"),
        _spans(F.col("rejected")).alias("rejected_spans"),
        (F.col("whole") & ((F.size("chosen") > 0) | (F.size("rejected") > 0))).alias("usable"),
    )


def echo_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: rejected is the conversation with its last assistant turn replaced by an echo of the turn before.

    Conversations without an assistant turn after another turn give no pair.
    """
    lists = turn_lists(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when((t["role"] == TRAINED_ROLE) & (i > 0), i)))
    found = lists.withColumn("_n", last).filter("_n IS NOT NULL")
    echoed = F.transform("turns", lambda t, i: F.when(i == F.col("_n"), F.struct(t["role"].alias("role"), F.element_at("turns", F.col("_n"))["text"].alias("text"))).otherwise(t))
    return found.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), echoed.alias("rejected"))


def format_conversations(turns: DataFrame) -> DataFrame:
    return preference_pairs(echo_pairs(turns))


ORACLE = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
x AS (SELECT conv_id, max(i) AS n FROM t WHERE role = 'assistant' AND i > 0 GROUP BY conv_id),
s AS (SELECT t.conv_id, t.i, t.role, t.text AS a, CASE WHEN t.i = x.n THEN q.text ELSE t.text END AS b
  FROM t JOIN x ON t.conv_id = x.conv_id LEFT JOIN t q ON q.conv_id = t.conv_id AND q.i = t.i - 1),
k AS (SELECT conv_id, coalesce(min(CASE WHEN a <> b THEN i END), count(*)) AS k FROM s GROUP BY conv_id),
r AS (SELECT s.*, k.k, '<|' || role || '|>' || chr(10) AS head FROM s JOIN k ON s.conv_id = k.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(a) + 1) FILTER (i >= k) OVER w, 0) AS at_a, coalesce(sum(length(head) + length(b) + 1) FILTER (i >= k) OVER w, 0) AS at_b
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, CAST(any_value(k) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(head || a || chr(10), '' ORDER BY i) FILTER (i < k), '') AS prompt,
  coalesce(string_agg(head || a || chr(10), '' ORDER BY i) FILTER (i >= k), '') AS chosen,
  coalesce(string_agg((at_a + length(head)) || '-' || (at_a + length(head) + length(a)), ',' ORDER BY i) FILTER (i >= k AND role = 'assistant' AND a <> ''), '') AS chosen_spans,
  coalesce(string_agg(head || b || chr(10), '' ORDER BY i) FILTER (i >= k), '') AS rejected,
  coalesce(string_agg((at_b + length(head)) || '-' || (at_b + length(head) + length(b)), ',' ORDER BY i) FILTER (i >= k AND role = 'assistant' AND b <> ''), '') AS rejected_spans,
  max(i) >= any_value(k) AS usable
FROM o GROUP BY conv_id
"""
