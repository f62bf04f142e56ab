"""The filter audit against its SQL and against plain loops over all orders; odd inputs."""

import itertools
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

from llm_samples import labels, no_documents, odd_documents
from oracle import compare, connect

from gridprobe.llm import audit
from gridprobe.llm.queries import ORACLES, QUERIES

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def plain(docs, marks):
    """{(part, order, step): counts}, with every order walked row by row."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        rows.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = defaultdict(Counter), Counter()
    for order in itertools.permutations("ABCDE"):
        for step, letter in enumerate(order, 1):
            for part, fails, is_good, is_toxic in rows:
                c = out[part, "".join(order), step]
                gone, fail = bool(fails & set(order[: step - 1])), letter in fails
                c["kept"] += not gone and not fail
                c["removed"] += fail and not gone
                c["redundant"] += fail and gone
                c["unique_fails"] += fails == {letter}
                c["good_lost"] += fail and not gone and is_good
                c["toxic_lost"] += fail and not gone and is_toxic
                shapley[part, letter] += fail and not gone
    return {k: (*(c[x] for x in COUNTS), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def check(docs, marks, rows):
    given = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    wanted = plain(given, [(r["doc_id"], r["quality"], r["toxic"]) for r in marks.collect()])
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in [*COUNTS, "shapley"]) for r in rows}
    assert got == wanted and len(rows) == len(wanted)


def test_query_agrees_with_sql(spark, sf):
    name = "op12_failing_id_audit"
    assert compare(spark, connect(sf), SimpleNamespace(run=QUERIES[name], sql=ORACLES[name]), sf) is None


def test_query_against_loops(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    check(read("documents"), read("labels"), QUERIES["op12_failing_id_audit"](spark, sf).collect())


def test_odd_documents(spark):
    docs = odd_documents(spark)
    docs = docs.union(docs.selectExpr("doc_id + 20", "concat(text, ' #1')", *docs.columns[2:]))
    marks = labels(spark, [(1, 1, 0), (2, 1, 1), (2, 0, None), (9, None, 1), (None, 1, 1), (5, 1, 1), (77, 1, 1)])
    check(docs, marks, audit.audited(docs, marks).collect())


def test_hot_texts_and_others(spark):
    """Texts that many rows share take the broadcast, others the shuffle, with one result."""
    texts = ["same"] * 40 + [f"text {i // 2}" for i in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i * 7 % 102, t, "p" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    marks = labels(spark, [(i, i % 2, (i + 1) % 2) for i in range(50)])
    rows = docs.selectExpr("doc_id AS id", "sha2(coalesce(text, ''), 256) AS digest")
    wanted = Counter(r["id"] for r in audit.repeats(rows).collect())
    assert sum(wanted.values()) == len(texts) - len({t or "" for t in texts})
    check(docs, marks, audit.audited(docs, marks).collect())
    audit.HOT, before = 5, audit.HOT
    try:
        assert Counter(r["id"] for r in audit.repeats(rows).collect()) == wanted
    finally:
        audit.HOT = before


def test_what_grows_with_the_rows_is_not_broadcast(spark, monkeypatch):
    """Small files give many rows once they are repeated for every prefix, so no size is taken from them."""
    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    plans, staged = {}, audit.stage

    def spy(df, label):
        plans[label] = plan(df)
        return staged(df, label)

    monkeypatch.setattr(audit, "stage", spy)
    docs = odd_documents(spark)
    rows, fails = audit.failing_ids(docs, labels(spark, [(i, i % 2, 0) for i in range(20)]))
    plans |= {name: plan(df) for name, df in audit.prefix_relations(rows, fails).items()}
    assert {"rows", "fails-E", "clean", "survivors", "removed", "redundant"} <= set(plans)
    # Texts that many rows share, at most HOT, are the one table that is broadcast.
    assert {name for name, text in plans.items() if "Broadcast" in text} == {"fails-E"}
    assert "SortMergeJoin" in plans["fails-E"]


def test_no_documents(spark):
    assert audit.audited(no_documents(spark), labels(spark, [])).collect() == []
