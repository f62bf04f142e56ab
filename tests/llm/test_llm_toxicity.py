"""The decoder against all paths of the lattice; held-out accuracy; odd inputs."""

import itertools
import time

import numpy as np
import pytest
from llm_samples import labels, no_documents, odd_documents

from gridprobe.llm import toxicity
from gridprobe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    counts = toxicity.trigram_counts(["stupid idiot moron " * 50, "the cat sat on the mat and was no idiot " * 20, None, ""])
    counts = counts.reshape((toxicity.SYMBOLS,) * 3) + 0.05
    return np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


def best_of_all(token, model):
    def score(path):
        code = [0, 0, *(toxicity._SYMBOL.get(c, 0 if c == " " else toxicity.OTHER) for c in "".join(p for p, _ in path)), 0]
        return sum(c for _, c in path) + sum(float(model[a, b, c]) for a, b, c in zip(code, code[1:], code[2:]))

    return max(score(path) for path in itertools.product(*toxicity.lattice(token)))


@pytest.mark.parametrize("token", ["1d10t", "st*p1d", "m0r0n", "i d i o t", "stuuuupid", "@", "4.0", "a-b", "$$x$$$", "!diot", "idi00t", "(m00r*n)!", "idioot!"])
def test_viterbi_finds_the_best_path(model, token):
    decoded = toxicity.decode(token, model)
    paths = itertools.product(*toxicity.lattice(token))
    reached = {"".join(p for p, _ in path).strip() for path in paths}
    assert decoded in reached
    restored = max(
        (sum(c for _, c in path) + sum(float(model[a, b, c]) for a, b, c in zip(code, code[1:], code[2:])))
        for path in itertools.product(*toxicity.lattice(token))
        if "".join(p for p, _ in path).strip() == decoded
        for code in [[0, 0, *(toxicity._SYMBOL.get(c, 0 if c == " " else toxicity.OTHER) for c in "".join(p for p, _ in path)), 0]]
    )
    assert restored == pytest.approx(best_of_all(token, model), abs=1e-4)


def test_disguises_are_read(model):
    for token in ("st*pid", "stup1d", "s.t.u.p.i.d", "stuuuupid", "s t u p i d", "$tupid"):
        assert toxicity.decode(token, model) == "stupid"
    assert toxicity.meant("(m0r0n),", model) == "moron" and toxicity.meant("cat.", model) == "cat"


def test_signs_at_the_ends_and_doubled_letters_are_read(model):
    for token in ("!diot", "!d!0t!", "idioot", "iddiot", "(idiot)", "*idiot*", "idi00t"):
        assert toxicity.meant(token, model) == "idiot"
    assert toxicity.meant("stuupid", model) == "stupid" and toxicity.meant("mat!", model) == "mat"


def test_words_of_the_corpus_keep_their_double_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.character_model(docs)
    tokens = {w for r in docs.select("text").collect() for w in (r["text"] or "").lower().split()}
    doubled = sorted(w for w in tokens if w.isalpha() and toxicity._TWICE.search(w) and not toxicity.re.search(r"(.)\1\1", w))
    kept = [w for w in doubled if toxicity.meant(w, model) == w]
    assert len(kept) >= 0.9 * len(doubled)
    for token, word in (("!diot", "idiot"), ("idioot", "idiot"), ("stuupid", "stupid"), ("(m0ron", "moron")):
        assert toxicity.meant(token, model) == word


def test_long_tokens_cost_time_in_proportion(model):
    token = "data:image/png;base64," + "".join(chr(97 + i * i % 26) + str(i % 10) + "ss+" for i in range(200_000))
    started = time.perf_counter()
    assert toxicity.decode(token, model)
    assert time.perf_counter() - started < 30


def test_symbols_and_counts():
    assert toxicity.symbols("aß!\U0001F600語").tolist() == [1, 27, 0, 0, toxicity.OTHER]
    counts = toxicity.trigram_counts(["ab ab"]).reshape((toxicity.SYMBOLS,) * 3)
    assert counts[1, 2, 0] == 2 and counts[0, 1, 2] == 2 and counts[0, 0, 0] == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op3_noisy_channel_toxicity"](spark, folder)
    told = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in told) / len(told) > 0.97
    assert sum(r["predicted"] for r in told if r["toxic"]) / sum(r["toxic"] for r in told) > 0.85
    assert rows.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0


def test_odd_documents(spark):
    docs = odd_documents(spark)
    given = labels(spark, [(1, 1, 1), (2, 0, 0), (5, 0, 0), (8, 1, 1), (None, 1, 1), (7, 1, None), (99, 0, 1)])
    rows = toxicity.classified(docs, given).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 6)}) == 1
    without = toxicity.classified(docs, given.filter("false")).collect()
    assert len({r["score"] for r in without}) == 1


def test_no_documents(spark):
    assert toxicity.classified(no_documents(spark), labels(spark, [(1, 1, 0)])).collect() == []
