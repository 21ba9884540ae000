from keyweave.llm.preference_pairs import format_preferences, repeated_answers
from keyweave.llm.queries import op6_every_conversation

SIDE = "pair_id bigint, turn bigint, role string, text string"


def shown(*turns):
    return "".join(f"<|{r}|>\n{t}\n" for r, t in turns)


def both(spark, chosen, rejected):
    found = format_preferences(spark.createDataFrame(chosen, SIDE), spark.createDataFrame(rejected, SIDE)).collect()
    return {r.pair_id: r for r in found}


def test_common_prefix_and_masks(spark):
    chosen = [(1, 0, "user", "Q"), (1, 1, "assistant", "good é"), (1, 2, "user", "more"), (1, 3, "assistant", "yes")]
    rejected = [(1, 0, "user", "Q"), (1, 1, "assistant", "bad")]
    r = both(spark, chosen, rejected)[1]
    assert (r.n_common, r.prompt) == (1, shown(("user", "Q")))
    assert r.chosen == shown(("assistant", "good é"), ("user", "more"), ("assistant", "yes"))
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["good é", "yes"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["bad"]


def test_cases(spark):
    chosen = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "user", "only here"), (None, 0, "user", "n"), (4, 0, "user", "a")]
    rejected = [(1, 0, "user", "a"), (2, 0, "user", ""), (2, 1, "", "y"), (None, 0, "user", "n"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    found = both(spark, chosen, rejected)
    assert sorted(found) == [1, 2, 4]
    assert (found[1].n_common, found[1].rejected, found[1].rejected_spans) == (1, "", [])
    assert found[2].n_common == 1 and found[2].prompt == shown(("user", ""))
    assert found[4].n_common == 0 and found[4].rejected == shown(("assistant", "a"), ("assistant", "a"))


def test_same_on_both_sides(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    r = both(spark, rows, rows)[1]
    assert (r.n_common, r.chosen, r.rejected) == (2, "", "")


def test_repeated_answers(spark):
    conv = "conv_id bigint, turn bigint, role string, text string, pair_id string"
    rows = [(1, 0, "user", "q", "own"), (1, 1, "assistant", "first", "own"), (1, 2, "user", "r", "own"), (1, 3, "assistant", "second", "own"), (1, 4, "user", "s", "own"), (2, 0, "assistant", "x", "own")]
    chosen, rejected = repeated_answers(spark.createDataFrame(rows, conv))
    assert [r.text for r in sorted(chosen.collect(), key=lambda r: r.turn)] == ["q", "first", "r", "second"]
    assert [r.text for r in sorted(rejected.collect(), key=lambda r: r.turn)] == ["q", "first", "r", "first"]


def test_every_conversation(spark):
    conv = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "end"), (2, 0, "user", "q"), (2, 1, "user", "r"), (3, 0, "assistant", "x"), (4, 0, "assistant", "a"), (4, 1, "assistant", "b")]
    found = {r.pair_id: r for r in format_preferences(*repeated_answers(spark.createDataFrame(rows, conv), every=True)).collect()}
    assert (found[1].prompt, found[1].chosen, found[1].rejected) == (shown(("user", "q")), shown(("assistant", "a")), shown(("assistant", "")))
    assert (found[2].prompt, found[2].chosen, found[2].rejected) == (shown(("user", "q"), ("user", "r")), "", "")
    assert (found[3].prompt, found[3].chosen) == ("", shown(("assistant", "x")))
    assert found[4].rejected == shown(("assistant", "a"))


def test_every_conversation_has_a_row(spark, folder):
    pairs = op6_every_conversation(spark, folder)
    assert pairs.count() == spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id").distinct().count()


def test_empty(spark):
    assert both(spark, [], []) == {}


def test_a_long_conversation_and_names_with_dots(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} " * 50) for i in range(1200)] + [(1, 1199, "assistant", "again")]
    df = spark.createDataFrame(rows, "`the.conv` bigint, `a.turn` bigint, `a.role` string, `a.text` string")
    chosen, rejected = repeated_answers(df, "the.conv", "a.turn", "a.role", "a.text")
    row = format_preferences(chosen, rejected).first()
    assert [row.chosen[s.start : s.end] for s in row.chosen_spans] == sorted(["1199 " * 50, "again"]) and row.n_common == 1199
    whole = format_preferences(chosen, rejected.where("turn < 0").union(rejected.limit(1))).first()
    assert len(whole.chosen_spans) == 601 and whole.chosen[whole.chosen_spans[-1].start :].rstrip("\n") in ("again", "1199 " * 50)
