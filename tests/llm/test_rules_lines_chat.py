"""Quality rules, line dedup, preference formatting: brute force and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from spanweave.llm import chat_pairs, line_dedup, quality_rules, queries

LONG = "the house is on the hill and it was old for me " * 20000


def _cells(rows):
    return sorted(repr([None if v is None or v != v else round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _cells(got.select(*[f"`{n}`" for n in names]).collect()) == _cells(want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


# --- quality rules


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rules_on_odd_texts(spark):
    got = {r.doc_id: r for r in quality_rules.measure(_docs(spark, [(1, None), (2, ""), (3, "###$$$"), (4, LONG), (5, "A tiny note.")])).collect()}
    assert got[1].failed == got[2].failed == "no_words" and not got[1].keep
    assert "symbols" in got[3].failed
    assert got[4].n_chars == len(LONG) and got[4].n_words == len(LONG.split())
    assert got[5].keep and got[5].n_words == 3


def test_rules_keep_repeated_rows_and_null_ids(spark):
    got = quality_rules.measure(_docs(spark, [(None, "a b"), (7, "a b"), (7, "a b")])).collect()
    assert sorted((r.doc_id or 0, r.keep) for r in got) == [(0, True), (7, True), (7, True)]


def test_accepted_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a fine text", "x", 3, None), (2, "", "y", 4, None)], "doc_id long, text string, failed string, n_words int, `a.b` string")
    got = quality_rules.accepted(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(1, "a fine text", "x", 3, None)]
    assert quality_rules.measure(docs).columns == ["doc_id", *quality_rules.MEASURES, "failed", "keep"]


def test_rules_on_an_empty_table(spark):
    assert quality_rules.measure(_docs(spark, [])).count() == 0 == quality_rules.accepted(_docs(spark, [])).count()


def test_blank_lines_between_paragraphs_are_no_repeated_lines(spark):
    paragraphs = [f"the story of day {k} is that it was a fine day and {chr(97 + k) * 3} met {chr(97 + k) * 4}" for k in range(26)]
    docs = _docs(spark, [(1, "\n\n".join(paragraphs)), (2, "\r\n \t\r\n".join(paragraphs)), (3, "\n\n".join(["the same line for all of it"] * 26))])
    got = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    assert got[1].keep and got[2].keep and got[1].n_lines == got[1].n_distinct_lines == got[2].n_lines == 26
    assert "repeated_lines" in got[3].failed and [r.doc_id for r in quality_rules.accepted(docs).collect()] == [1, 2]


def test_a_clean_very_long_text_has_no_repeated_words(spark):
    """300,000 words of which 8,000 are distinct (2.7 %), as in natural prose of that length; junk of that length still fails."""
    letters = "abcdefghijklmnopqrst"
    prose = " ".join(f"the {letters[k % 20]}{letters[k // 20 % 20]}{letters[k // 400 % 20]}o of" for k in range(100_000))
    docs = _docs(spark, [(1, prose), (2, LONG)])
    got = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    assert got[1].n_words == 300_000 and got[1].n_distinct_words == 8_002 and got[1].keep
    assert "repeated_words" in got[2].failed


def test_rules_use_no_user_functions(spark, sf_dir):
    plan = queries.queries()["op8_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- line dedup


def _brute(docs):
    """The documents' texts without the lines that repeated windows cover."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    seen, cut = set(), {}
    for i in order:
        lines = (docs[i][1] or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        cut[i] = (len(gone), None if docs[i][1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return [(docs[i][0], *cut[i]) for i in range(len(docs))]


def test_lines_equal_brute_force(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc\na\nb\nc"), (4, None), (5, ""), (6, "a\nb"), (7, "q\nq\nq\nq\nq"), (8, "\n\n\n\n"), (9, "\n".join(f"l{k % 7}" for k in range(3000)))]
    got = [(r.doc_id, r.n_removed, r.text) for r in line_dedup.line_dedup(_docs(spark, docs)).collect()]
    assert sorted(got, key=repr) == sorted(_brute(docs), key=repr)


def test_lines_null_ids_repeats_and_shared_ids(spark):
    docs = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "u\nv\nw"), (2, "z\nu\nv\nw")]
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in line_dedup.line_dedup(_docs(spark, docs)).collect()), key=repr)
    assert [g for g in got if g[0] is None] == [(None, 0, "a\nb\nc")]
    assert [g for g in got if g[0] == 1] == [(1, 3, ""), (1, 3, "")]  # repeated rows are one document, each gets its result
    assert sum(g[1] for g in got if g[0] == 2) == 3  # versions that share an id are documents of their own


def test_lines_keep_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5, "k"), (2, "a\nb\nc\nd", 6, None)], "doc_id long, text string, n_removed int, _id string")
    got = line_dedup.deduped(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a\nb\nc", 5, "k"), (2, "d", 6, None)]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# --- preference formatting

TURN = "role string, text string"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, f"pair_id long, chosen array<struct<{TURN.replace(' string', ':string')}>>, rejected array<struct<{TURN.replace(' string', ':string')}>>")


def _plain(turns):
    return "".join(f"<|{r}|>\n{t}\n" for r, t in turns)


def test_pairs_share_one_prompt_and_mask_the_rest(spark):
    head = [("system", "be kind"), ("user", "hi")]
    chosen, rejected = [*head, ("assistant", "hello"), ("user", "so?"), ("assistant", "yes")], [*head, ("assistant", "go")]
    (r,) = chat_pairs.preference_pairs(_pairs(spark, [(1, chosen, rejected)])).collect()
    assert r.n_prompt_turns == 2 and r.prompt == _plain(head) and r.usable
    assert r.prompt + r.chosen == _plain(chosen) and r.prompt + r.rejected == _plain(rejected)
    assert [r.chosen[int(a) : int(b)] for a, b in (s.split("-") for s in r.chosen_spans.split(","))] == ["hello", "yes"]
    assert [r.rejected[int(a) : int(b)] for a, b in (s.split("-") for s in r.rejected_spans.split(","))] == ["go"]


def test_pairs_on_odd_rows(spark):
    one = [("user", "a")]
    rows = [(1, one, one), (2, [], []), (3, one, []), (4, one, [*one, ("assistant", "b")]), (5, [(None, "a")], [(None, "a")]), (6, None, one), (7, one, None), (8, None, None)]
    got = {r.pair_id: r for r in chat_pairs.preference_pairs(_pairs(spark, rows)).collect()}
    assert not got[1].usable and got[1].chosen == got[1].rejected == ""
    assert not got[2].usable and got[2].n_prompt_turns == 0
    assert got[3].usable and got[3].n_prompt_turns == 0
    assert got[4].chosen == "" and got[4].rejected_spans
    assert got[5].n_prompt_turns == 1
    said = _plain(one)
    assert tuple(got[6]) == (6, 0, "", "", "", said, "", False) and tuple(got[7]) == (7, 0, "", said, "", "", "", False)
    assert tuple(got[8]) == (8, 0, "", "", "", "", "", False)
    long = "<|assistant|>\n" * 50_000
    (r,) = chat_pairs.preference_pairs(_pairs(spark, [(9, [("assistant", long)], [("assistant", "<|x|>")])])).collect()
    a, b = map(int, r.chosen_spans.split("-"))
    assert r.chosen[a:b] == long and r.rejected[slice(*map(int, r.rejected_spans.split("-")))] == "<|x|>"
    assert chat_pairs.preference_pairs(_pairs(spark, [])).count() == 0


def test_conversations_with_nulls_repeats_and_other_columns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "y"), (1, 1, "assistant", "a", "y"), (2, 0, "user", None, None), (2, 1, "assistant", "z", None), (None, 0, "user", "n", None), (None, 1, "assistant", "m", None), (3, None, None, "lost", None)],
        "conv_id long, turn int, role string, text string, turns string",
    )
    got = {r.pair_id: r for r in chat_pairs.format_conversations(turns).collect()}
    assert set(got) == {1, 2, None}
    assert got[1].n_prompt_turns == 3 and not got[1].usable  # the echo of a repeated turn is the turn itself
    assert got[2].rejected == "<|assistant|>\n\n" and got[2].rejected_spans == ""
    assert got[None].usable
    assert chat_pairs.format_conversations(turns.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.col("id").cast("string"), 50).alias("text"))
    (r,) = chat_pairs.format_conversations(turns).collect()
    assert r.n_prompt_turns == 2999 and r.usable
