"""The hidden Markov model against all state paths; exact base scores; odd inputs."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_samples import no_documents, odd_documents

from gridprobe.llm import hmm
from gridprobe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(0)
    chain = hmm.Chain(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    seqs = [rng.integers(0, 6, n).astype(np.int16) for n in (4, 1, 6, 3, 6)]
    total, counts = [], np.zeros(3 + 9 + 18)
    for seq in seqs:
        whole, start, move, emit = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
        for path in itertools.product(range(3), repeat=len(seq)):
            p = chain.start[path[0]] * chain.emit[seq[0], path[0]]
            for a, b, seen in zip(path, path[1:], seq[1:]):
                p *= chain.move[a, b] * chain.emit[seen, b]
            whole += p
            start[path[0]] += p
            for a, b in zip(path, path[1:]):
                move[a, b] += p
            for seen, a in zip(seq, path):
                emit[seen, a] += p
        total.append(math.log10(whole))
        counts += np.concatenate((start, move.ravel(), emit.ravel())) / whole
    return chain, seqs, total, counts


def test_forward_is_the_sum_over_paths(case):
    chain, seqs, total, _ = case
    assert np.allclose(hmm.sequence_scores(chain, seqs), total)


def test_expected_counts(case):
    chain, seqs, total, counts = case
    got = hmm.expected_counts(chain, seqs)
    assert np.allclose(got[:-1], counts) and got[-1] == pytest.approx(sum(total))


def test_windows_and_lots_lose_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    chain = hmm.Chain.initial(np.full(5, 0.2), 2)
    seqs = [rng.integers(0, 5, n).astype(np.int16) for n in (700, 3, 256, 257)]
    got = hmm.expected_counts(chain, seqs)
    assert got[2 + 4 : -1].sum() == pytest.approx(sum(map(len, seqs)))


def whole_counts(chain, seq):
    """Starts, moves, emissions and log10 probability by a plain forward-backward over the whole sequence."""
    n, k = len(seq), len(chain.start)
    fore, back, shrink = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        fore[t] = (fore[t - 1] @ chain.move if t else chain.start) * chain.emit[seq[t]]
        shrink[t] = fore[t].sum()
        fore[t] /= shrink[t]
    for t in range(n - 2, -1, -1):
        back[t] = chain.move @ (chain.emit[seq[t + 1]] * back[t + 1]) / shrink[t + 1]
    moves, emits = np.zeros((k, k)), np.zeros(chain.emit.shape)
    for t in range(n):
        emits[seq[t]] += fore[t] * back[t]
        if t:
            moves += np.outer(fore[t - 1], chain.emit[seq[t]] * back[t]) * chain.move / shrink[t]
    return np.concatenate((fore[0] * back[0], moves.ravel(), emits.ravel(), [np.log10(shrink).sum()]))


def test_windows_count_as_the_whole_text():
    rng = np.random.default_rng(3)
    chain = hmm.Chain.initial(rng.dirichlet(np.ones(12)), 4)
    chain.start = np.array([0.97, 0.01, 0.01, 0.01])
    seqs = [rng.integers(0, 12, n).astype(np.int16) for n in (1000, 5, 512, 513, 2600, 1025, 1)]
    wanted = sum(whole_counts(chain, s) for s in seqs)
    got = hmm.expected_counts(chain, seqs)
    assert np.allclose(got, wanted, rtol=2e-4, atol=2e-3)
    # Starts are those of the texts, and every text but its first token is reached by a move.
    assert got[:4].sum() == pytest.approx(len(seqs)) and got[4:20].sum() == pytest.approx(sum(map(len, seqs)) - len(seqs), rel=1e-5)


def check_base(docs, rows):
    counts = Counter()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    for i, text in docs:
        if not held[i]:
            counts.update((text or "").encode().lower().split())
            counts[b""] += 1
    n, v = counts.total(), len(counts)
    wanted = Counter()
    for i, text in docs:
        tokens = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        wanted[i, held[i], len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4)] += 1
    got = Counter((*(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(r["base_score"], 4)) for r in rows)
    assert got == wanted


def test_query(spark, sf, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    monkeypatch.setattr(hmm, "FREQUENT", 40)
    rows = QUERIES["op10_hidden_markov_scores"](spark, sf).collect()
    check_base(docs, rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # With few words held, the others come through the join, and nothing changes.
    monkeypatch.setattr(hmm, "HELD_WORDS", 50)
    joined = QUERIES["op10_hidden_markov_scores"](spark, sf).collect()
    check_base(docs, joined)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert all(r["score"] == pytest.approx(by_id[r["doc_id"]], abs=1e-6) for r in joined)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = hmm.scored(docs, iterations=2).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], rows)
    assert all(math.isfinite(r["score"]) for r in rows)


def test_a_rare_end_is_held(spark, monkeypatch):
    # One end in 301 tokens, which is rarer than 1 / HELD_WORDS here.
    monkeypatch.setattr(hmm, "HELD_WORDS", 50)
    docs = spark.createDataFrame([(1, "a b c " * 100)], "doc_id long, text string")
    counts = hmm.summed_up(hmm.word_counts(docs.select("text")))
    place = counts.own[hmm.END]
    assert counts.held[hmm.END] == 1 and counts.class_tokens[place] == counts.class_words[place] == 1
    check_base([(1, "a b c " * 100)], hmm.scored(docs, iterations=1).collect())


def test_training_has_six_passes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    score = lambda **more: {r["doc_id"]: r["score"] for r in hmm.scored(docs, **more).collect()}
    whole, six, five = score(), score(iterations=6), score(iterations=5)
    assert whole == pytest.approx(six, abs=1e-6) and whole != pytest.approx(five, abs=1e-6)


def test_no_documents(spark):
    assert hmm.scored(no_documents(spark), iterations=1).collect() == []
