import re
import zlib
from collections import Counter

import pytest

from keyweave.llm.queries import QUERIES
from keyweave.llm.spelling_variants import LONG, VariantRule, group_variants, near_words, spelling_variants, word_counts


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_counts(rows, rule):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            mark = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if rule.every and mark % rule.every == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= rule.least_letters and n >= rule.least_count}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


LISTS = {
    "chain": {"abcdef": 1000, "abcdeg": 200, "abcdg": 40, "abcd": 8, "abc": 1, "bcdef": 200},
    "ties": {"aaaaaa": 5, "aaaaa": 25, "aaaaaaa": 25, "aaaaab": 25, "éaaaaa": 25, "baaaaa": 4},
    "repeated letters": {"aab": 1, "ab": 5, "aaab": 7, "aabb": 9, "a": 2, "b": 90, "bb": 3},
    "long": {"x" * LONG: 1, "x" * (LONG + 1): 5, "x" * (LONG - 1): 2, "x" * (LONG + 2) + "y": 9, "x" * (LONG + 3): 50, "yx" * 40: 3, "yx" * 40 + "z": 60},
    "one letter each": {c + "bcdef": ord(c) for c in "abcdefghijklmnopqrstuvwxyzàéÿ"} | {"bcdef": 9000},
}


@pytest.mark.parametrize("name", LISTS)
def test_word_lists(spark, name):
    words = spark.createDataFrame(list(LISTS[name].items()), "word string, n bigint")
    assert rows_of(group_variants(words)) == plain_variants(LISTS[name])


def test_each_pair_once(spark):
    words = spark.createDataFrame([(w, n) for w, n in LISTS["repeated letters"].items()], "word string, n bigint")
    pairs = [(r.word, r.near) for r in near_words(words).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in LISTS["repeated letters"] for b in LISTS["repeated letters"] if is_near(a, b)}


def test_words_that_have_no_neighbours(spark):
    words = spark.createDataFrame([(None, 3), ("", 2), ("a\0b", 1), ("ab", 1)], "word string, n bigint")
    assert near_words(words).collect() == []
    assert {(r.word, r.n_near) for r in group_variants(words).collect()} == {(None, 0), ("", 0), ("a\0b", 0), ("ab", 0)}


def test_texts(spark):
    rows = [(i, "The WORDED worded wordéd, ÀBCDÉFG àbcdéfg x" + "n" * 5) for i in range(40)] + [(None, "wordedd wordedd"), (7, None), (8, "")]
    rows += [(50 + i, "wordedd Werded ÀBCDÉFG' letter" + "s" * i) for i in range(9)] + [(9, "again again letters " * 3000), (9, "again again letters " * 3000)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    for rule in (VariantRule(), VariantRule(every=3), VariantRule(least_letters=2, least_count=1, every=7)):
        assert rows_of(spelling_variants(df, rule=rule)) == plain_variants(plain_counts(rows, rule))


def test_a_very_long_word(spark):
    long = "ab" * 20_000
    df = spark.createDataFrame([(i, long if i else f"{long}c") for i in range(6)] + [(9, f"{long}c")] * 5, "doc_id bigint, text string")
    found = rows_of(spelling_variants(df))
    assert [(w == long, n, k) for w, n, k, *_ in found] == [(True, 5, 1), (False, 6, 1)]


def test_columns_with_other_names(spark):
    df = spark.createDataFrame([("k", "common common common common common commons")] * 5, "`my id` string, `the.text` string")
    assert {(r.word, r.n) for r in word_counts(df, "my id", "the.text").collect()} == {("common", 25), ("commons", 5)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants(df).collect() == []


def test_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = rows_of(QUERIES["op13_spelling_variants"](spark, folder))
    assert found == plain_variants(plain_counts(rows, VariantRule(every=199))) and any(r[3] for r in found)
