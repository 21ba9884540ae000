import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from keyweave.llm import ngram_join
from keyweave.llm.components import components
from keyweave.llm.ngram_join import Similarity, one_of_each_group, reaching, similar_groups


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(values):
    """By all pairs: (size, smallest id reached)."""
    sets, root = [shingles(v) for v in values], list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def group_texts(rng, copies, length=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("long_list", [2, 32])
def test_against_all_pairs(texts, long_list):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    values = [None, "", " \n", "one two", "One TWO", "one two three", "a b c d e", "A b c d e", "x " * 3000]
    values += [t for n in (2, 3, 9, 40) for t in group_texts(rng, n)]
    values += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(2, 40))) for _ in range(40)]
    values += values[10:14]
    df = texts(values, extra=["size", "cls", "id"])
    rule = Similarity(long_list=long_list)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, rule=rule).collect()}
    assert [rows[i] for i in range(len(values))] == plain(values)


def test_edges_of_the_threshold(texts):
    words = [f"w{i}" for i in range(13)]  # nine shingles
    values = [" ".join(words), " ".join(words[:12]), " ".join(words[:11]), " ".join(words[2:]), " ".join(words[:3])]
    rows = {r.doc_id: r.component_id for r in similar_groups(texts(values)).collect()}
    assert [rows[i] for i in range(5)] == [c for _, c in plain(values)]


def test_one_of_each_group(spark, texts):
    df = texts(["a b c d e f", "a b c d e f", "other words are here now", None, None], extra=["component_id"])
    again = df.union(df.where("doc_id = 0"))
    nameless = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1, "own")], df.schema)
    kept = one_of_each_group(again.union(nameless)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 2, 3, 4]
    assert sum(r.doc_id is None for r in kept) == 1
    assert kept[0].component_id == "own"


def test_one_id_with_several_texts(spark):
    """A text stays with its own group, whatever other texts its id names."""
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (0, "a b c d e f"), (1, "m n o p q r"), (1, "M n o p  q r"), (1, None), (1, ""), (3, None), (2, "s t u v w x")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, cls string")
    kept = sorted((r.doc_id, r.text or "") for r in one_of_each_group(df).collect())
    assert kept == [(0, "a b c d e f"), (1, ""), (1, "M n o p  q r"), (1, "g h i j k l"), (2, "s t u v w x"), (3, "")]
    again = sorted((r.doc_id, r.text or "") for r in one_of_each_group(df.repartition(7)).collect())
    assert again == kept


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (None, "a b c d e f"), (7, "g h i j k l")]
    found = similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in found) == [(False, 1, 1), (False, 1, 1), (False, 7, 1), (True, 0, 1)]


def test_empty_table(texts):
    assert similar_groups(texts([])).collect() == []


def test_bounded_names(texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_NAMED", 3)
    rng = random.Random(5)
    values = list(group_texts(rng, 30)) + list(group_texts(rng, 30))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(texts(values), rule=Similarity(long_list=2)).collect()}
    assert [rows[i] for i in range(len(values))] == plain(values)


def test_too_few_common_lists(spark):
    prefixes = spark.createDataFrame([(1, 100, [1, 2]), (2, 100, [2, 3]), (3, 100, list(range(20))), (4, 100, list(range(20)))], "cls bigint, size int, shingles array<bigint>")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a bigint, b bigint")
    assert [tuple(r) for r in reaching(pairs, prefixes, Similarity()).collect()] == [(3, 4)]


def test_components_of_chain_star_and_loops(spark):
    order = random.Random(1).sample(range(1000), 300)
    links = list(zip(order, order[1:])) + [(2000, i) for i in range(2001, 2100)] + [(5000, 5000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: min(order) for i in order} | {i: 2000 for i in range(2000, 2100)}


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], ["id", "text", "at"])


def test_packed_marks_are_all_fingerprints():
    values = [" ".join(f"w{i * j}" for j in range(30)) for i in range(200)] + ["", None, "one two"] * 2
    for buckets in (1, 7, 5000):
        found = []
        for packed in ngram_join._pack(iter([batch_of(values)]), 5, buckets):
            for row in packed.to_pylist():
                found += [row["bucket"] << 32 | int(x) for x in np.frombuffer(row["marks"], np.uint32)]
        sets = {ngram_join.class_of(s): s for _, s in ngram_join._documents(iter([batch_of(values)]), 5) if len(s)}
        assert sorted(found) == sorted(int(x) for s in sets.values() for x in ngram_join.fingerprints(s, buckets))


def test_tasks_hold_a_block_of_shingles_at_a_time():
    """What a task holds doesn't grow with its texts or with Spark's batch of them: a million shingles are 8 MB."""
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(1500)]  # three million shingles
    every = np.full(len(texts) // 8 + 1, 255, np.uint8)
    held = {}
    for name, task in (("measure", lambda b: ngram_join._measure(b, 5)), ("pack", lambda b: ngram_join._pack(b, 5, 48)), ("again", lambda b: ngram_join._make_again(b, 5, every))):
        batch, rows = batch_of(texts), 0
        tracemalloc.start()
        for found in task(iter([batch])):
            rows += found.num_rows
            del found
        held[name] = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert rows >= (48 if name == "pack" else len(texts))
    assert held["measure"] < 2 and held["pack"] < 30 and held["again"] < 30, held
