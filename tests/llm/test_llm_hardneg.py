"""Hard negatives against their SQL and against plain loops; the index against all pairs; odd inputs."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from gridprobe.llm import hardneg
from gridprobe.llm.queries import ORACLES, QUERIES

NAME = "op11_l2ap_hard_negatives"


def test_query_agrees_with_sql(spark, sf):
    assert compare(spark, connect(sf), SimpleNamespace(run=QUERIES[NAME], sql=ORACLES[NAME]), sf) is None


def plain(rows, is_anchor, positives=5, negatives=3):
    """Every anchor against every row."""
    rows = [
        (i, label, v) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = [(-int(sum(x * y for x, y in zip(v, w))), j, other) for j, other, w in rows if j != i and len(w) == len(v)]
        for p, j in sorted((s, j) for s, j, other in scored if other == label)[:positives]:
            p = -p
            inside = sorted((s, k) for s, k, other in scored if other != label and 50 * p <= -100 * s <= 95 * p)
            # Rows that repeat an id are other rows only among each other's labels.
            out += [(i, j, rank, k, p, -s) for rank, (s, k) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def ran(spark, rows, every=5):
    points = spark.createDataFrame(rows, "vec_id long, label int, vec array<double>").withColumns(
        {"row": F.lit("r"), "id": F.lit(1), "dim": F.lit(0), "score": F.lit(None).cast("string")}
    )
    return sorted(map(tuple, hardneg.mined(points, F.col("vec_id") % every == 0).collect()))


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 40)
    monkeypatch.setattr(hardneg, "GROUP", 7)


def test_against_loops(spark, small_blocks):
    """Copies, near copies, a label with a third of all rows, a label of one row, zero vectors and many blocks."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 60, (6, 20))
    rows = []
    for i in range(260):
        label = 0 if i % 3 == 0 else int(rng.integers(1, 5))
        v = np.floor(centre[i % 6] + rng.normal(0, 25, 20)) if i % 4 else rng.integers(-90, 90, 20).astype(float)
        rows.append((i, label, v.tolist()))
    rows += [(300 + i, i % 3, rows[7][2]) for i in range(12)] + [(400 + i, i % 2, [0.0] * 20) for i in range(8)]
    rows += [(500, 99, rows[3][2]), (505, 3, (-np.array(rows[3][2])).tolist())]
    assert ran(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark, small_blocks):
    v = [3.0, -4.0, 5.0]
    rows = [
        (0, 1, v), (1, 1, v), (2, 2, [2.0, -3.0, 3.0]), (3, 2, None), (4, None, v), (None, 1, v), (5, 1, [1.0, None, 2.0]),
        (6, 2, [float("nan"), 1.0, 1.0]), (7, 2, [float("inf"), 1.0, 1.0]), (8, 2, [1.0, 2.0]), (10, 1, [1.0, 2.0]),
        (11, 1, [2.0, 4.0]), (15, 3, []), (16, 3, []), (17, 4, []), (2, 2, [2.0, -3.0, 3.0]), (9, 2, [2.0, -3.0, 3.0]),
    ]
    got = ran(spark, rows)
    assert got == plain(rows, lambda i: i % 5 == 0)
    assert {r[0] for r in got} == {0, 10, 15}


def test_empty_and_without_anchors(spark):
    assert ran(spark, []) == []
    assert ran(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []


def test_scores_that_are_not_exact(spark):
    with pytest.raises(ValueError, match="squared norm"):
        ran(spark, [(0, 1, [1e9]), (1, 1, [1e9])])


@pytest.mark.parametrize("share", [0.9, 0.5, 0.1, -0.2, None])
def test_index_finds_all_above_any_threshold(share):
    """And the lists name fewer rows, the higher the threshold is."""
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 50, (300, 37)) * rng.uniform(0, 2, 37) // 1
    norms = hardneg._suffix_norms(x)
    block = object.__new__(hardneg._Block)
    block.ids, block.labels, block.dims = np.arange(300), np.zeros(300, int), np.arange(37)
    block.x, block.norms = x, norms
    block.lists = np.argsort(-norms[:, :-1], axis=0, kind="stable").T
    q = x[:20]
    least = np.full(20, -np.inf) if share is None else share * (q**2).sum(axis=1)
    a, r, score = block.reaching(q, least, np.arange(0, 300, 2))
    wanted = q @ x[::2].T
    assert sorted(zip(a, r, score)) == [(i, 2 * j, wanted[i, j]) for i, j in np.argwhere(wanted >= least[:, None])]


def test_copies_of_anchors_are_not_broadcast(spark, small_blocks, monkeypatch):
    """Groups go to every block; no plan sends these copies through the driver, whatever size it takes them for."""
    plans, staged = [], hardneg.stage

    def spy(df, label):
        if label == "found":
            df.collect()
            plans.append(df._jdf.queryExecution().toString())
        return staged(df, label)

    monkeypatch.setattr(hardneg, "stage", spy)
    rng = np.random.default_rng(11)
    rows = [(i, i % 3, rng.integers(-50, 50, 12).astype(float).tolist()) for i in range(200)]
    assert ran(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    assert plans and not any("Broadcast" in plan for plan in plans)


def test_tiles_of_several_blocks_and_lots(spark, small_blocks, monkeypatch):
    """Tasks that keep several blocks and meet several groups return the best of all blocks, for each length of vectors."""
    monkeypatch.setattr(hardneg, "HELD", 40 * 9 * 3)
    monkeypatch.setattr(hardneg, "LOT", 2)
    monkeypatch.setattr(hardneg, "TILES", 0)
    monkeypatch.setattr(hardneg, "ROWS", 16)
    rng = np.random.default_rng(13)
    rows = [(i, i % 4, rng.integers(-60, 60, 9 if i % 3 else 5).astype(float).tolist()) for i in range(400)]
    assert ran(spark, rows, 2) == plain(rows, lambda i: i % 2 == 0)
