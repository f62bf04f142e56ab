"""NN-descent against all pairs; dense groups, copies, odd inputs."""

import numpy as np

from gridprobe.llm import neighbours


def plain(ids, x):
    """{id: (links, component)} by all pairs; rows of ``x`` that are None link with nothing."""
    usable = [i for i, v in enumerate(x) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and np.any(v)]
    m = np.array([x[i] for i in usable], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    low = np.array([ids[i] for i in usable])
    while True:
        lower = np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lower == low).all():
            break
        low = lower
    found = {ids[i]: (0, ids[i]) for i in range(len(ids))}
    for k, i in enumerate(usable):
        found[ids[i]] = (int(near[k].sum()) - 1, int(low[k]))
    return found


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [c if c is None else float(c) for c in v], 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rep int")


def test_all_links_with_saturated_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12))
    for start, n in ((0, 60), (100, 12), (200, 2)):  # dense groups, one several lists and blocks large
        x[start : start + n] = x[start] + 0.05 * rng.normal(size=(n, 12))
    x[250:255] = x[249]  # copies
    x = x.astype(np.float32)
    ids = list(range(7, 307))
    rows = neighbours.near_duplicates(frame(spark, ids, x), k=5).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == plain(ids, list(x))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows) and len(rows) == 300


def test_links_between_groups_whose_own_members_are_nearer(spark):
    rng = np.random.default_rng(5)
    a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    centres = a, 0.97 * a + np.sqrt(1 - 0.97**2) * b
    x = np.concatenate([c + 0.01 * rng.normal(size=(40, 16)) for c in centres] + [rng.normal(size=(60, 16))]).astype(np.float32)
    ids = list(range(len(x)))
    rows = neighbours.near_duplicates(frame(spark, ids, x), k=5).collect()
    wanted = plain(ids, list(x))
    assert wanted[0][0] > 60 and {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == wanted


def test_audit_counts_vectors_not_links():
    group = [(3999, 3999)] * 4000
    assert neighbours.least_recall(group + [(1, 1)] * 200) == 1.0
    assert neighbours.least_recall(group + [(0, 1)] * 200) == 0.0
    assert neighbours.least_recall(group + [(200, 400)] * 400) == 0.5
    assert neighbours.least_recall([(0, 0)]) == 1.0


def test_few_vectors_do_not_judge_by_themselves():
    many = [(1, 1)] * 200
    assert neighbours.least_recall([*many, (15, 16)]) > 0.99
    assert neighbours.least_recall([*many, *[(15, 16)] * neighbours.AUDITED_GROUP]) == 15 / 16
    assert neighbours.least_recall([(1, 1, 1.0)] * 30 + [(0, 1, 10.0)]) == 30 / 40


def test_audit_draws_rare_linked_vectors(spark, monkeypatch):
    """Three pairs among 600 vectors; the search has one of them, has seen one just below, and none of the third."""
    monkeypatch.setattr(neighbours, "AUDITED", {"dense": 8, "linked": 8, "close": 8, "far": 600})
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 24))
    x[1], x[3], x[5] = x[0], x[2], x[4]
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "rep long, vec array<double>, copies long")
    degrees = spark.createDataFrame([(0, 1, False), (1, 1, False)], "rep long, links long, dense boolean")
    graph = spark.createDataFrame([(2, 9, 0.9), (3, 9, 0.9), (4, 9, 0.1)], "src long, dst long, sim double")
    assert abs(neighbours._audit(vectors, degrees, graph, 0.95) - 1 / 3) < 1e-9
    found = spark.createDataFrame([(i, 1, False) for i in range(6)], "rep long, links long, dense boolean")
    assert neighbours._audit(vectors, found, graph, 0.95) == 1.0


def test_rounds_compare_only_pairs_with_a_fresh_edge(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(4, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "rep long, vec array<double>, copies long")

    def pairs(*fresh):
        edges = [(0, i, float(x[0] @ x[i]), f) for i, f in enumerate(fresh, 1)]
        found = neighbours.local_joins(spark.createDataFrame(edges, "src long, dst long, sim double, fresh boolean"), vectors, 5)
        return {(r["src"], r["dst"]) for r in found.collect() if r["src"] < r["dst"] and r["src"] > 0}

    assert pairs(True, True, True) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(True, False, False) == {(1, 2), (1, 3)} and pairs(False, False, False) == set()


def test_short_recall_is_finished_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "WIDENINGS", 0)
    monkeypatch.setattr(neighbours, "descended", lambda vectors, *a: vectors.selectExpr("rep AS src", "rep AS dst", "0D AS sim"))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x[:20] = x[0] + 0.05 * rng.normal(size=(20, 8))
    ids = list(range(60))
    rows = neighbours.near_duplicates(frame(spark, ids, x.astype(np.float32)), k=5).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == plain(ids, list(x.astype(np.float32)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], [2, 0.001], None, [], [0, 0], [nan, 1], [inf, 1], [None, 1], [-1, 0], [1e30, 0], [1e-30, 0], [-0.0, 1.0], [0.0, 1.0]]
    x = [v if not v else v for v in x]
    ids = list(range(len(x)))
    rows = neighbours.near_duplicates(frame(spark, ids, x)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == plain(ids, x)
    again = neighbours.near_duplicates(frame(spark, [5, 5, 3, None], [[1, 0], [1, 0], [0, 1], [1, 0]])).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in again) == [(-1, 0), (3, 0), (5, 1), (5, 1)]


def test_lengths_do_not_link(spark):
    """A length of its own for three rows, for one, and for the rest, in which a prefix would link."""
    rng = np.random.default_rng(8)
    long, short = rng.normal(size=(40, 9)), rng.normal(size=(3, 5))
    long[10:25] = long[10] + 0.02 * rng.normal(size=(15, 9))
    short[1] = short[0]
    x = [*[list(map(float, np.float32(v))) for v in (*long, *short)], [1.0], [2.0, 3.0, 4.0]]
    ids = list(range(len(x)))
    want = {}
    for width in {len(v) for v in x}:
        of = [i for i in ids if len(x[i]) == width]
        want |= plain(of, [x[i] for i in of])
    rows = neighbours.near_duplicates(frame(spark, ids, x), k=5).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == want and want[41] == (1, 40)


def test_no_vectors(spark):
    assert neighbours.near_duplicates(frame(spark, [], [])).collect() == []
    assert [tuple(r) for r in neighbours.near_duplicates(frame(spark, [4], [None])).collect()] == [(4, 0, 4, True)]
