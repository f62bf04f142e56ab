"""The pipeline against plain loops, its contract, odd inputs; queries against their SQL."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from llm_samples import no_documents, odd_documents
from test_llm_decontaminate import plain as plain_hits
from test_llm_mixing import check as check_mix
from test_llm_simhash import plain_components, plain_fingerprint
from test_llm_spans import plain as plain_cut

import corpus_pipeline
from gridprobe.llm import quality
from gridprobe.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_sql(spark, sf, name):
    assert compare(spark, connect(sf), SimpleNamespace(run=QUERIES[name], sql=ORACLES[name]), sf) is None


def test_stages_against_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    texts = {i: r["text"] for i, r in given.items()}

    field = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    order = sorted(texts)
    scores = quality.document_scores(field, [texts[i].encode() for i in order])
    texts = {i: texts[i] for i, s in zip(order, scores) if s >= 0.3}
    low = plain_components([(i, plain_fingerprint(t)) for i, t in texts.items()])
    texts = plain_cut({i: t for i, t in texts.items() if low[i] == i})
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    hit = {i for i, _ in plain_hits(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in hit}

    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(t.encode().split()) for i, t in texts.items()}
    check_mix(rows, [given[r["doc_id"]]["source"] for r in rows])


def test_stages_keep_columns_of_odd_documents(spark, sf):
    docs = odd_documents(spark)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.collect()
        assert function(spark, no_documents(spark), sf).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_entry_lives_without_this_part(tmp_path):
    """The entry module of a copy without the pipeline still imports and has the other queries."""
    for name in ("__spark_entry__.py", "gridprobe"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else os.makedirs(tmp_path / name)
    for name in os.listdir(f"{ROOT}/gridprobe"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/gridprobe/{name}", tmp_path / "gridprobe" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); exec(open({ROOT + '/__spark_entry__.py'!r}).read().replace('os.path.dirname(os.path.abspath(__file__))', repr({str(tmp_path)!r}))); q = queries(); print(len(q), any(n.startswith('op') and n[2:3].isdigit() for n in q), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert said.returncode == 0, said.stderr
    n, any_op, pipeline = said.stdout.split()
    assert int(n) >= 119 and any_op == "False" and pipeline == "False"
