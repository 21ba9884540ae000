import re
from collections import Counter

import pytest

from keyweave.llm.quality_rules import apply_quality_rules
from keyweave.llm.queries import op2_quality_rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


ROWS = [
    None,
    "",
    " \t\n",
    "a b c d e f g h " * 3,
    "same line\nsame line\n\n \nsame line",
    "q w e r t y u i o p q w e r t y u i x",
    "é 漢字 😀 #*$%&|<>\x0b end",
    "the and of " * 40_000,
]


def test_counts(texts):
    rows = {r.doc_id: r for r in apply_quality_rules(texts(ROWS, extra=["kept", "_words", "_measures"])).collect()}
    for i, text in enumerate(ROWS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and (r.kept is False or not failed)
        assert r._words == r._measures == "own"


def test_far_histograms_are_dropped(spark, texts):
    ordinary = [f"the cat {i} and the dog of number{i} went to a house in the town that was by sea{i} and it is on with as for you " * 1 for i in range(40)]
    ordinary = [" ".join(f"{w}" for w in (t + f" {t[::-1]} ").split()) + " " + " ".join(f"word{i}x{j} the of" for j in range(20)) for i, t in enumerate(ordinary)]
    odd = " ".join(f"#{i}$%&*|<>" for i in range(200))
    rows = {r.doc_id: r for r in apply_quality_rules(texts([*ordinary, odd])).collect()}
    assert not rows[len(ordinary)].base_failed and not rows[len(ordinary)].kept
    assert all(rows[i].kept for i in range(len(ordinary)))


def test_languages_and_empty_table(spark, texts):
    df = texts(["word " * 5] * 2).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert [r.kept for r in apply_quality_rules(df).collect()] == [False, False]
    assert apply_quality_rules(texts([])).collect() == []


def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op2_quality_rules(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(docs[r.doc_id])
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert junk and sum(not r.kept for r in junk) == pytest.approx(len(junk), rel=0.5)
