import random

import numpy as np
import pytest

from keyweave.lineage import cut
from keyweave.operators import boxes


def meet(a, b):
    return a[3] * a[4] * b[3] * b[4] > 0 and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]


def area(a, b):
    wide = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    high = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    return wide * high if meet(a, b) else 0.0


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, x double, y double, width double, height double")


def some_boxes(seed, n, span):
    rng = random.Random(seed)
    return [(i, float(rng.randrange(span)), float(rng.randrange(span)), float(rng.randrange(9)), float(rng.randrange(1, 9))) for i in range(n)]


@pytest.mark.parametrize("span, chunk_bits", [(12, 20), (60, 3)])
def test_overlaps_and_areas_match_all_pairs(spark, monkeypatch, span, chunk_bits):
    monkeypatch.setattr(boxes, "CHUNK_BITS", chunk_bits)
    rows = some_boxes(span, 80, span)
    df = frame(spark, rows)
    counts = {r.id: r.overlaps for r in boxes.overlap_counts(df).collect()}
    assert counts == {a[0]: sum(meet(a, b) for b in rows if a is not b) for a in rows}
    areas = {r.id: r.area for r in boxes.overlap_areas(df).collect()}
    assert areas == {a[0]: sum((area(a, b) for b in rows if a is not b), 0.0) for a in rows}


@pytest.mark.parametrize("seed", range(3))
def test_sums_before_match_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = (0, 9, 130)[seed]
    by_x, by_y, weights = rng.permutation(n), rng.permutation(n), rng.integers(-5, 6, n)
    x, y = np.argsort(by_x), np.argsort(by_y)
    expected = [weights[(x < x[i]) & (y < y[i])].sum() for i in range(n)]
    assert boxes.sums_before(by_x, by_y, [weights, weights * 0.5])[1].tolist() == [e * 0.5 for e in expected]


def test_a_corner_is_shuffled_as_one_row(spark, monkeypatch):
    """Not as one for each binary digit of its place: rows written grow with the corners."""
    written = []
    monkeypatch.setattr(boxes, "cut", lambda df, label: written.append((label, df.count())) or cut(df, label))
    rows = [(i, 1.0, 1.0, 2.0, 2.0) for i in range(300)]
    monkeypatch.setattr(boxes, "CHUNK_BITS", 6)
    assert boxes.count_overlaps(frame(spark, rows)).first().pairs == 300 * 299 // 2
    sizes = dict(written)
    assert sizes["slabs"] == sizes["chunks"] == 4 * 300


def test_boxes_without_end_or_area(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0.0, 0.0, inf, 2.0), (2, 5.0, 1.0, 1.0, 1.0), (3, 7.0, -0.0, nan, 1.5), (4, 0.0, 0.0, 0.0, 9.0), (5, 7.0, 0.0, 1.0, None), (1, 8.0, 0.0, 1.0, 1.0)]
    got = sorted((r.id, r.overlaps) for r in boxes.overlap_counts(frame(spark, rows)).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (3, 2), (4, 0), (5, 0)]


def test_touching_boxes_do_not_overlap(spark):
    df = frame(spark, [(1, 0.0, 0.0, 2.0, 2.0), (2, 2.0, 0.0, 2.0, 2.0), (3, 0.0, 2.0, 2.0, 2.0), (4, 1.0, 1.0, 0.5, 0.5)])
    assert boxes.count_overlaps(df).first().pairs == 1


def test_many_boxes_on_one_spot(spark):
    df = frame(spark, [(i, 1.0, 1.0, 2.0, 2.0) for i in range(300)])
    assert boxes.count_overlaps(df).first().pairs == 300 * 299 // 2


def test_selection_and_centres(spark):
    df = frame(spark, [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 5.0, 5.0), (3, 20.0, 0.0, 5.0, 5.0), (4, -5.0, -5.0, 100.0, 100.0)])
    assert sorted(r.id for r in boxes.select_boxes(df, 10, 0, 10, 10).collect()) == [1, 2, 4]
    assert boxes.count_centers(df, 5, 5, reach=5).first().boxes == 1


def test_edge_lengths(spark):
    df = frame(spark, [(1, 0.0, 0.0, 2.0, 3.0), (2, 3.0, 4.0, 3.0, 3.0)])
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "src bigint, dst bigint")
    assert [tuple(r) for r in boxes.edge_lengths(edges, df).collect()] == [(1, 2, 5.0)]
