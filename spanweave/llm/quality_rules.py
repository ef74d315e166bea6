"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is an integer count and every rule compares two products of
integers, so a row's verdict doesn't depend on rounding.

Lines are counted without blank ones, which would else make many paragraphs look
like repeated lines. The share of distinct words falls with length alone, so it
is asked of ``SHARE_WORDS`` words at most: a longer text needs no more distinct
words than one of that length.

Defined cases: a null or empty text has zero counts and fails ``no_words``;
texts of any length are measured whole; repeated rows are judged each on its
own; a null in any other column plays no part; an empty table gives an empty
table. ``measure`` returns the id and its own columns only, so other columns of
the input can't clash; ``accepted`` returns the input's columns unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in a is that for it as was with be by on are this from or an at has have not which "
            "der die das und ist nicht ein eine den von zu mit auf für dem sich des im es als auch werden aus er hat dass sie nach bei "
            "le la les de et est un une du en que qui dans pour pas sur au ce il ne se plus par avec "
            "el los las y una no por con para su al lo del mi".split()
        )
    )
)

#: name, counted, times, compared, counted, times, asked only of texts with so many words.
#: A document fails a rule when ``left * a  <op>  right * b``.
RULES = (
    ("no_words", "n_words", 1, "<", "one", 1, 0),
    ("symbols", "n_symbols", 100, ">", "n_chars", 8, 0),
    ("upper_case", "n_upper", 100, ">", "n_letters", 60, 10),
    ("few_stop_words", "n_stop", 100, "<", "n_words", 5, 50),
    ("only_stop_words", "n_stop", 100, ">", "n_words", 75, 50),
    ("repeated_words", "n_distinct_words", 100, "<", "n_words", 10, 50),
    ("repeated_lines", "n_distinct_lines", 100, "<", "n_lines", 60, 20),
    ("long_words", "n_letters", 1, ">", "n_words", 20, 10),
)

#: Rules whose compared count is taken as so much at most.
SHARE_WORDS = 20_000
_AT_MOST = {"repeated_words": SHARE_WORDS}

MEASURES = ("n_chars", "n_words", "n_letters", "n_symbols", "n_upper", "n_stop", "n_distinct_words", "n_lines", "n_distinct_lines")


def _measures(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    first = docs.select(
        *[F.col(f"`{k}`") for k in keep],
        t.alias("_t"),
        F.array_remove(F.split(F.lower(t), r"[^\p{L}]+"), "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\s\p{Z}]")).alias("_l"),
    )
    return first.select(
        *[F.col(f"`{k}`") for k in keep],
        F.length("_t").cast("long").alias("n_chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_t", r"[\p{L}\p{N}\s.,;:]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_l")).cast("long").alias("n_distinct_lines"),
    )


def _failed(rules) -> Column:
    def side(name: str, times: int) -> Column:
        return (F.lit(1) if name == "one" else F.col(name)) * F.lit(times)

    names = []
    for name, left, a, op, right, b, words in rules:
        x, y = side(left, a), side(right, b)
        if name in _AT_MOST:
            y = F.least(y, F.lit(_AT_MOST[name] * b))
        hit = (x < y) if op == "<" else (x > y)
        names.append(F.when(hit & (F.col("n_words") >= words), F.lit(name)))
    return F.concat_ws(",", *names)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: its counts, the rules it fails, and whether it stays."""
    m = _measures(docs, text_col, id_col).withColumn("failed", _failed(rules))
    return m.select(F.col(f"`{id_col}`").alias("doc_id"), *MEASURES, "failed", (F.col("failed") == "").alias("keep"))


def accepted(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that fail no rule, with the columns they came with."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    m = _measures(whole, "_text", "_row").filter(_failed(rules) == "")
    return m.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


_SW = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_failed() -> str:
    parts = []
    for name, left, a, op, right, b, words in RULES:
        x, y = ("1" if side == "one" else side for side in (left, right))
        y = f"least({y}, {_AT_MOST[name]})" if name in _AT_MOST else y
        parts.append(f"CASE WHEN {x} * {a} {op} {y} * {b} AND n_words >= {words} THEN '{name}' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


def sql_measures(table: str, keep: str = "doc_id") -> str:
    """DuckDB text of the measures over ``table``."""
    return f"""
SELECT {keep}, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS n_letters,
  CAST(length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s.,;:]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(list_filter(w, lambda x: x IN ({_SW}))) AS BIGINT) AS n_stop,
  CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct_lines
FROM (SELECT *, coalesce(text, '') AS t,
  list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B\\p{{Z}}]')) AS l FROM {table})"""


def oracle() -> str:
    return f"SELECT *, failed = '' AS keep FROM (SELECT *, {sql_failed()} AS failed FROM ({sql_measures('documents')}))"
