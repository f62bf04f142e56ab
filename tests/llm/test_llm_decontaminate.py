"""Decontamination against all windows; odd inputs."""

from collections import Counter

from llm_samples import no_documents, odd_documents

from gridprobe.llm import decontaminate
from gridprobe.llm.queries import QUERIES


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def plain(docs, items):
    """{(id, item): similarity} over every window of every text."""
    found = {}
    for item, text in items.items():
        target = (text or "").encode().lower().split()
        wanted = shingles(target)
        for i, body in docs.items():
            words = (body or "").encode().lower().split()
            length = min(len(target), len(words))
            if not length or not (shingles(words).keys() & wanted.keys()):
                continue
            best = 0.0
            for a in range(len(words) - length + 1):
                window = shingles(words[a : a + length])
                both = sum((window & wanted).values())
                best = max(best, both / (window.total() + wanted.total() - both))
            if best >= 0.8:
                found[i, item] = round(best, 9)
    return found


def test_query_against_all_windows(spark, sf):
    read = lambda name, key: {r[key]: r["text"] for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()}
    wanted = plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    rows = QUERIES["op9_simhash_window_decontamination"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows} == wanted and wanted


def test_near_copies_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    words = [f"w{i}" for i in range(40)]
    changed = words.copy()
    changed[20] = "other"
    far = [w if i % 6 else "other" for i, w in enumerate(words)]
    docs = {1: " ".join(["pre", *words, "post"]), 2: " ".join(["x y", *changed]), 3: " ".join(far), 4: "a b c", 5: " ".join(words[:35])}
    items = {10: " ".join(words).upper(), 11: "A b C", 12: None, 13: "", 14: " ".join(words)}
    got = decontaminate.contaminated(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == plain(docs, items)
    assert {(1, 10), (1, 14), (4, 11)} <= {(r["doc_id"], r["item_id"]) for r in got}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "one"), (None, "one"), (2, None), (3, " ")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == [(7, 0), (7, 1)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_no_documents_or_items(spark):
    none = no_documents(spark)
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.contaminated(none, items).collect() == []
    assert decontaminate.contaminated(odd_documents(spark), items.filter("false")).collect() == []
