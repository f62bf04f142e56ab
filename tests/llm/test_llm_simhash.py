"""SimHash: fingerprints against the definition, the trie against all pairs, components, odd inputs."""

import numpy as np
import pytest
import xxhash
from llm_samples import no_documents, odd_documents

from gridprobe.llm import simhash
from gridprobe.llm.components import connected_components
from gridprobe.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """Least id reachable over links, by repeated relaxation; ``marks`` is a list of (id, fingerprint)."""
    low = {i: i for i, _ in marks}
    changed = True
    while changed:
        changed = False
        for a, x in marks:
            for b, y in marks:
                if (x ^ y).bit_count() <= 4 and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    found = list(base)
    for b in base[:60]:
        for _ in range(6):
            flipped = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                flipped ^= 1 << int(bit)
            found.append(flipped)
    return np.unique(np.array(found, np.uint64))


def test_trie_finds_all_pairs(values):
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    wanted = set(zip(*(x.tolist() for x in np.nonzero(np.triu(far <= 4, 1)))))
    found = set()
    for by in (0, 32):
        turned = simhash._rotated(values, by)
        order = np.argsort(turned)
        for a, b in simhash.linked_pairs(turned[order], None, 0, 2, 4):
            found |= {(min(p), max(p)) for p in zip(order[a].tolist(), order[b].tolist())}
    assert found == wanted and len(wanted) > 300


@pytest.mark.parametrize("node_rows", [2048, 16])
def test_cut_trie_connects_the_same(spark, values, node_rows):
    ids = values.view(np.int64).tolist()
    distinct = spark.createDataFrame([(i,) for i in ids], "fp long")
    nodes = {r["node"]: r["component"] for r in connected_components(simhash.trie_links(distinct, 4, node_rows)).collect()}
    marks = sorted(zip(ids, values.tolist()))
    assert {i: nodes.get(i, i) for i in ids} == plain_components(marks)


def test_query_against_all_pairs(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_simhash_trie_components"](spark, sf).collect()
    marks = [(i, plain_fingerprint(t)) for i, t in sorted(docs.items())]
    low = plain_components(marks)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{m:016x}", low[i]) for i, m in marks}
    assert len(rows) == len(docs)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == by_id[6]["fingerprint"] == "0" * 16
    assert by_id[6]["component_id"] == 3 and by_id[2]["component_id"] == 1
    kept = simhash.representatives(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    assert [r["doc_id"] for r in kept].count(2) == 0 and [r["doc_id"] for r in kept].count(1) == 1
    assert [r["doc_id"] for r in kept].count(None) == 1  # the other NULL id has the text of documents 3, 4 and 6


def test_no_documents(spark):
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    nodes = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert nodes == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
