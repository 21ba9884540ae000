import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyweave.llm.prefix_trie import WIDTH, _digests, _nodes, grafted_trie, prefix_trie
from keyweave.llm.queries import QUERIES
from keyweave.llm.radix_tree import Full, Indexed, Sorted, bottom_up, build

TURNS = "conv_id bigint, turn bigint, role string, text string"


def identity(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def grouped(rows):
    """Each conversation's turns in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), identity(role or "", text or ""), (role or "", text or "")))
    return {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}


def grafted(convs):
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return made


def plain(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node)).encode()).hexdigest(),
        )
        for node, own in members.items()
    )


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*names).collect())


def dialogue(rng, n, most):
    """Conversations that share first turns, some whole ones, some longer than most."""
    rows = []
    for c in range(n):
        length = rng.choice([1, 2, 3, most])
        for turn in range(length):
            rows.append((c * 7 % 997, turn, rng.choice(["user", "assistant"]), f"é{rng.randrange(2 if turn < 3 else 9)}" * rng.randrange(1, 3)))
    return rows


ODD = [
    (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", "b"), (5, 1, "user", "b"), (7, 3, "", ""), (7, 3, None, "b"), (None, 1, "user", "lost"),
    (-3, 1, "user", "x"), (8, 2**40, "user", "long " * 30_000), (9, 1, "a", "bc"), (10, 1, "ab", "c"), (100, 1, "user", "root"), (101, 1, "user", "mine"),
    (250, 1, "user", "no base"), (299, 1, "user", "no base"), (298, 1, "user", "no base"), (297, 1, "user", "no base"),
]


@pytest.mark.parametrize("partitions", ["1", "8", "41"])
def test_against_plain(spark, partitions):
    rng = random.Random(3)
    rows = dialogue(rng, 120, 6) + ODD
    df = spark.createDataFrame(rows, TURNS).withColumns({"conv": F.lit("own"), "key": F.lit(1), "place": F.lit(2)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows_of(prefix_trie(df)) == plain(grouped(rows))
        if partitions == "8":
            assert rows_of(grafted_trie(df)) == plain(grafted(grouped(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_are_dealt_to_several_tasks(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(3)]
    assert rows_of(prefix_trie(spark.createDataFrame(rows, TURNS))) == plain(grouped(rows))


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(3000 - c)]
    found = rows_of(prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert len(found) == 3000 and found[0][:6] == (1, 0, -1, 2, 1, 1) and found[0][6] == sum(len(f"turn {t}") for t in range(2998))


def test_empty_table(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie(df).collect() == [] and grafted_trie(df).collect() == []


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_prefix_trie"](spark, folder)) == plain(grafted(grouped(rows)))


def test_layouts_grow():
    layout, kinds = Sorted(), []
    for byte in random.Random(1).sample(range(256), 256):
        layout = layout.put(byte, byte)
        kinds.append((type(layout), getattr(layout, "room", 0)))
        assert layout.find(byte) == byte and layout.find((byte + 1) % 256) in (None, (byte + 1) % 256)
    assert list(layout.children()) == list(range(256))
    assert [kinds.index(k) + 1 for k in dict.fromkeys(kinds)] == [1, 5, 17, 49]
    assert {k[0] for k in kinds} == {Sorted, Indexed, Full}


def test_tree_finds_every_key():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(9))) for _ in range(400)] + [bytes([b]) * 40 for b in range(256)]
    top = build(keys)
    for row, key in enumerate(keys):
        node = top
        while node.end < len(key):
            node = node.layout.find(key[node.end])
            assert keys[node.first][: node.end] == key[: node.end]
        assert row in node.ends
    nodes = list(bottom_up(top))
    assert sum(len(n.ends) for n in nodes) == len(keys)
    assert all(n.end > n.start and (len(list(n.children())) > 1 or n.ends) for n in nodes if n is not top)  # paths are compressed
    assert build([]) is None


def test_no_node_within_a_turn():
    """Two ids that share their first bytes branch below one node, not within."""
    a, b = bytes(WIDTH), bytes(WIDTH - 1) + b"\1"
    rows = [r for batch in _nodes([a + a, a + b, b + a], [[3, 4], [3, 5], [6, 4]], [4, 5, 6]) for r in batch.to_pylist()]
    assert {r["depth"] for r in rows if r["kind"] != "ends"} == {0, 1, 2} and len({r["node"] for r in rows if r["kind"] == "border"}) == 5
    assert [(r["conv"], r["above"], r["parent"] is not None) for r in rows if r["kind"] == "whole"] == [(5, None, True)]


def test_ids_in_several_pieces():
    import pyarrow as pa

    pieces = [pa.RecordBatch.from_pydict({"node": [b"a", b"a"], "place": [1, 3], "ends": ["1,2", "3"]}), pa.RecordBatch.from_pydict({"node": [b"a", b"b"], "place": [4, 1], "ends": ["4", "9"]})]
    found = [r for batch in _digests(iter(pieces)) for r in batch.to_pylist()]
    assert [(r["node"], r["ends_sha256"]) for r in found] == [(b"a", hashlib.sha256(b"1,2,3,4").hexdigest()), (b"b", hashlib.sha256(b"9").hexdigest())]
