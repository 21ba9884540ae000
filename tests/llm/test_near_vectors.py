from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyweave.llm import vector_groups
from keyweave.llm.neighbour_graph import NearRule, best_of
from keyweave.llm.queries import QUERIES, SQL
from keyweave.llm.vector_groups import _spanning, near_vectors

VECTORS = "vec_id bigint, embedding array<double>"
SMALL = NearRule(neighbours=3, most_neighbours=6, tables=2, leaf=8, block=8, audited=64)


def plain(rows, cosine=0.9):
    def sound(v):
        return bool(v) and None not in v and all(np.isfinite(v)) and any(v)

    units = [np.array(v) / max(map(abs, v)) if sound(v) else None for _, v in rows]
    units = [u / np.sqrt(u @ u) if u is not None else None for u in units]
    near = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine] for i, x in enumerate(units)]
    found = []
    for i, (name, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in near[k] if j not in seen and not seen.add(j)]
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        found.append((name, len(near[i]), least, least == name))
    return Counter(found)


def rows_of(df, rule=NearRule()):
    return Counter(tuple(r) for r in near_vectors(df, rule=rule).select("vec_id", "n_links", "component_id", "kept").collect())


def around(rng, centre, n, angle):
    """Unit vectors at an angle of the centre."""
    side = rng.standard_normal((n, len(centre)))
    side -= np.outer(side @ centre, centre)
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.cos(angle) * centre + np.sin(angle) * side


def crowds():
    """Two tight crowds that only their edges link, a loose one, a chain, copies, and vectors alone."""
    rng = np.random.RandomState(4)
    a, b = np.eye(16)[0], np.cos(0.6) * np.eye(16)[0] + np.sin(0.6) * np.eye(16)[1]
    middle = np.cos(0.3) * np.eye(16)[0] + np.sin(0.3) * np.eye(16)[1]
    parts = [around(rng, a, 40, 0.05), around(rng, b, 40, 0.05), [middle], around(rng, np.eye(16)[5], 60, 0.3)]
    turn = np.arange(30) * 0.2
    parts.append(np.outer(np.cos(turn), np.eye(16)[8]) + np.outer(np.sin(turn), np.eye(16)[9]))
    parts.append(np.tile(around(rng, np.eye(16)[12], 3, 0.1), (15, 1)))
    parts.append(rng.standard_normal((80, 16)))
    vectors = [(v * s).tolist() for v, s in zip(np.concatenate(parts), rng.uniform(0.1, 9, 400), strict=False)]
    return list(zip(rng.permutation(len(vectors)).tolist(), vectors, strict=True))


@pytest.mark.parametrize("whole", [8, 512])
def test_crowds(spark, monkeypatch, whole):
    monkeypatch.setattr(vector_groups, "WHOLE", whole)
    monkeypatch.setattr(vector_groups, "CHUNK", 8)
    monkeypatch.setattr(vector_groups, "PANEL", 16)
    rows = crowds()
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("own") for c in ("node", "unit", "n_links", "id")})
    assert rows_of(df, SMALL) == plain(rows)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 3.0]), (5, [1.0, float("nan"), 3.0]), (6, [float("inf"), 1.0, 1.0]), (7, one), (7, one), (7, [3.0, -2.0, 1.0]),
        (None, one), (None, [-1.0, 5.0, 0.0]), (8, [x * 1e300 for x in one]), (9, [x * 1e-300 for x in one]), (10, [-x for x in one]), (11, [1.0]), (12, [2.0]), (13, [-2.0]), (14, [*one, 0.0]),
    ]
    found = rows_of(spark.createDataFrame(rows, VECTORS), SMALL)
    assert found == plain(rows) and found[(7, 4, 7, True)] == 2


def test_floats_and_names(spark):
    df = spark.createDataFrame([("b", [1.0, 0.1]), ("a", [1.0, 0.2]), ("c", [0.0, 1.0])], "`my id` string, `the.vector` array<float>")
    found = near_vectors(df, "my id", "the.vector").collect()
    assert sorted((r["my id"], r.n_links, r.component_id, r.kept) for r in found) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert rows_of(spark.createDataFrame([(1, None)], VECTORS)) == Counter([(1, 0, 1, True)])


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op12_near_vectors"](spark, folder).select("vec_id", "n_links", "component_id", "kept").collect()) == plain(rows)


def test_sql_defines_the_same():
    import duckdb

    rows, con = crowds(), duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows[:150] + [(900, None), (901, [0.0] * 16)])
    held = [(n, None if v is None else [float(np.float32(x)) for x in v]) for n, v in rows[:150] + [(900, None), (901, [0.0] * 16)]]
    assert Counter(con.execute(SQL["op12_near_vectors"]).fetchall()) == plain(held)


def test_best_of_each_node():
    node, other, sim = np.array([1, 1, 1, 2, 1]), np.array([5, 6, 5, 7, 8]), np.array([0.5, 0.7, 0.5, 0.1, 0.6])
    assert [x.tolist() for x in best_of(node, other, sim, 2)] == [[1, 1, 2], [6, 8, 7], [0.7, 0.6, 0.1]]


def test_spanning_links():
    rng = np.random.RandomState(1)
    for share in (0.05, 0.2, 0.9):
        linked = rng.uniform(size=(20, 30)) < share
        found = _spanning(linked)

        def groups(pairs):
            root = {}
            for i, j in pairs:
                a, b = ("r", i), ("c", j)
                ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
                if ra is not rb:
                    ra |= rb
                    for x in rb:
                        root[x] = ra
            return {frozenset(g) for g in root.values()}

        whole = groups(zip(*np.nonzero(linked), strict=True))
        assert groups(found) == whole and len(found) == sum(len(g) - 1 for g in whole) and all(linked[i, j] for i, j in found)
