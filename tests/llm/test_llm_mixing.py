"""Mixing: targets against plain reweighting, sums near targets, whole copies, reruns, odd inputs."""

from collections import defaultdict

import pytest
from llm_samples import no_documents, odd_documents

from gridprobe.llm import mixing
from gridprobe.llm.queries import QUERIES


def plain_targets(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(rows, sources):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r, source in zip(rows, sources):
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    wanted = plain_targets(sizes)
    for source in sizes:
        assert target[source] == pytest.approx(wanted[source], rel=1e-9, abs=1e-6)
    return sizes, taken, wanted


def test_targets_and_sums(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(QUERIES["op7_entropy_balanced_mix"](spark, sf).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(docs)
    sizes, taken, wanted = check(rows, [docs[r["doc_id"]]["source"] for r in rows])
    for source in sizes:
        assert abs(taken[source] - wanted[source]) <= 0.05 * wanted[source] + 60
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]["text"].encode().split())
        assert r["source_size"] == sizes[docs[r["doc_id"]]["source"]]
    again = sorted(QUERIES["op7_entropy_balanced_mix"](spark, sf).collect(), key=lambda r: r["doc_id"])
    assert again == rows


def test_rates_are_exponentially_tilted(spark, sf):
    """Within a source log(rate) is a line through zero in the size, up to the cap."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    rows = QUERIES["op7_entropy_balanced_mix"](spark, sf).join(docs, "doc_id").selectExpr("source", "size", "rate", "ln(rate) / size AS tilt")
    spread = rows.filter("size > 0 AND rate < 3").groupBy("source").agg({"tilt": "max"}).join(
        rows.filter("size > 0 AND rate < 3").groupBy("source").agg({"tilt": "min"}), "source"
    )
    for r in spread.collect():
        assert r["max(tilt)"] == pytest.approx(r["min(tilt)"], rel=1e-6, abs=1e-12)


def test_hot_cell_is_split(spark):
    """Equal documents of one source, many times the size of a ranked group."""
    n = 3 * mixing.RANKED
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(n)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == n
    _, taken, wanted = check(rows, ["s" if r["doc_id"] % 3 else "t" for r in rows])
    for source in wanted:
        assert abs(taken[source] - wanted[source]) <= 3


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"]: r["taken"] for r in rows if r["doc_id"] in (3, 4, 6)} == {3: 0, 4: 0, 6: 0}
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2


def test_no_documents(spark):
    assert mixing.mix(no_documents(spark)).collect() == []
