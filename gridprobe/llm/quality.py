"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.llm.common import fold_of, labelled_sample, release, stage, sum_of_parts, texts

# Labelled documents the field is fitted on, in expectation.
SAMPLE = 8_000
FOLDS = 5
THRESHOLD = 0.3
ROUNDS = 30
RIDGE = 2e-4
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
# ASCII signs that prose has few of.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-;:?()")
# A feature that is a share also enters as a step at each of these.
_STEPS = (0.02, 0.1, 0.3, 0.6)
_SHARES = 10


def line_features(line: bytes, times: int) -> list[float]:
    """Numbers that describe a line by itself; ``times`` is how often the document has it."""
    words = line.split()
    n, size = len(words), max(len(line), 1)
    letters = size - len(line.translate(None, _LETTERS))
    share = lambda chars, of: (len(line) - len(line.translate(None, chars))) / max(of, 1)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        share(_UPPER, letters), share(_DIGITS, size), share(_SIGNS, size), line.count(b"|") / max(n, 1), line.count(b"!") / max(n, 1),
        same / max(n - 1, 1), 1 - distinct / max(n, 1), line.count(b".") / max(n, 1), float(times > 1), letters / size,
        math.log1p(n), min(len(line) / max(n, 1), 30.0) / 10, float(line[-1:] in b".!?" and n > 0), float(n == 0),
    ]


N_OWN = _SHARES + 4 + _SHARES * len(_STEPS)


def expanded(rows: np.ndarray) -> np.ndarray:
    steps = [rows[:, :_SHARES] > s for s in _STEPS]
    return np.hstack([rows, *steps]).astype(np.float64)


@dataclass
class Lines:
    """The lines of several documents: features with those of both neighbours, and where documents begin."""

    x: np.ndarray
    length: np.ndarray
    starts: np.ndarray


def raw_lines(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths, and where documents begin and end. Documents without text are one empty line."""
    rows, length, starts = [], [], [0]
    for text in values:
        lines = (text or b"").split(b"\n")
        times = Counter(lines)
        for line in lines:
            rows.append(line_features(line, times[line]))
            length.append(len(line) + 1)
        starts.append(len(rows))
    return np.array(rows, np.float32).reshape(-1, _SHARES + 4), np.array(length, np.float64), np.array(starts)


def with_neighbours(raw: np.ndarray, length: np.ndarray, starts: np.ndarray) -> Lines:
    own = expanded(raw)
    ahead, behind = np.zeros_like(own), np.zeros_like(own)
    ahead[1:], behind[:-1] = own[:-1], own[1:]
    ahead[starts[:-1]] = 0.0
    behind[starts[1:] - 1] = 0.0
    return Lines(np.hstack([np.ones((len(own), 1)), own, ahead, behind]), length, starts)


N_FEATURES = 1 + 3 * N_OWN


@dataclass
class Field:
    """Weights of label 1 per feature, and scores of label pairs of neighbouring lines."""

    weights: np.ndarray
    moves: np.ndarray  # [label of the line before, label]

    @staticmethod
    def of(flat: np.ndarray) -> Field:
        return Field(flat[:N_FEATURES], flat[N_FEATURES:].reshape(2, 2))


def marginals(field: Field, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line the probability of label 1, the expected label pairs per document summed over all, and the
    logarithm of each document's partition sum. Documents advance together, longest first."""
    scores = lines.x @ field.weights
    first, n = lines.starts[:-1], np.diff(lines.starts)
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    active = np.searchsorted(-n, -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
    unary = np.stack([np.zeros_like(scores), scores], 1)
    fore = np.empty_like(unary)
    for t, k in enumerate(active):
        at = first[:k] + t
        if t == 0:
            fore[at] = unary[at]
        else:
            before = fore[at - 1]
            fore[at] = unary[at] + np.logaddexp(before[:, :1] + field.moves[0], before[:, 1:] + field.moves[1])
    total = np.logaddexp(*fore[first + n - 1].T) if len(n) else np.empty(0)
    back = np.zeros_like(unary)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        at = first[:k] + t
        ahead = unary[at + 1] + back[at + 1]
        both = field.moves[None] + ahead[:, None, :]
        back[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        pairs += np.exp(fore[at][:, :, None] + both - total[:k, None, None]).sum(0)
    place = np.empty(len(lines.x))
    for d in range(len(n)):
        place[first[d] : first[d] + n[d]] = total[d]
    good = np.exp(fore[:, 1] + back[:, 1] - place)
    unsorted = np.empty_like(total)
    unsorted[order] = total
    return good, pairs, unsorted


def _gradient(field: Field, lines: Lines, labels: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient, and number of lines, as one vector; every line has its document's label."""
    good, pairs, total = marginals(field, lines)
    n = np.diff(lines.starts)
    truth = np.repeat(labels, n).astype(np.float64)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (n[labels == label] - 1).sum()
    reached = float((lines.x @ field.weights) @ truth + (seen * field.moves).sum() - total.sum())
    slope = np.concatenate((lines.x.T @ (truth - good), (seen - pairs).ravel()))
    return np.concatenate(([reached], slope, [len(truth)]))


def _lbfgs(value, start: np.ndarray, rounds: int) -> np.ndarray:
    """Minimises a smooth function; ``value`` gives it with its gradient. Keeps the best point seen."""
    x, (fx, g) = start, value(start)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = g.copy(), []
        for s, y in reversed(memory):
            a = s @ q / (y @ s)
            used.append(a)
            q -= a * y
        if memory:
            s, y = memory[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.abs(g).sum(), 1.0)
        for (s, y), a in zip(memory, reversed(used)):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0
        for _ in range(12):
            trial = x - step * q
            ft, gt = value(trial)
            if ft <= fx - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, y = trial - x, gt - g
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y)]
        done = fx - ft < 1e-5 * max(abs(fx), 1e-3)
        x, fx, g = trial, ft, gt
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = FOLDS, sample: int = SAMPLE) -> Field:
    """Fits the field on labelled documents outside fold 0, ``sample`` of them in expectation.

    Each evaluation of likelihood and gradient is a pass over the sample's lines, of which every task returns one
    vector of sums. Without any labelled row all weights are zero and every score is a half.
    """
    wanted = labelled_sample(labels, label_col, folds, sample)
    rows = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(wanted, "sample_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, _, starts = raw_lines(texts(batch.column("text")))
                given = batch.column("sample_label").to_numpy().astype(np.int64)
                blobs = {"raw": raw, "starts": starts.astype(np.int64), "labels": given}
                yield pa.record_batch({k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})

    # Rows of features for some documents each; they are small, so every evaluation reads them again.
    kept = stage(
        rows.select("text", "sample_label").repartition(12).mapInArrow(read, "raw binary, starts binary, labels binary"), "sample"
    )

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw, starts, given in zip(*(batch.column(c).to_pylist() for c in ("raw", "starts", "labels"))):
                    rows = np.frombuffer(raw, np.float32).reshape(-1, _SHARES + 4)
                    lines = with_neighbours(rows, np.ones(len(rows)), np.frombuffer(starts, np.int64))
                    part = _gradient(Field.of(flat), lines, np.frombuffer(given, np.int64))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

        got = sum_of_parts(kept.mapInArrow(work, "part binary"))
        if got is None:
            return 0.0, np.zeros_like(flat)
        n = got[-1]
        return -got[0] / n + RIDGE / 2 * flat @ flat, -got[1:-1] / n + RIDGE * flat

    flat = _lbfgs(evaluate, np.zeros(N_FEATURES + 4), ROUNDS)
    release(kept)
    return Field.of(flat)


def document_scores(field: Field, values: list[bytes | None]) -> np.ndarray:
    """Per document the probability that its text is good: the lines' marginals, weighted by length."""
    if not values:
        return np.empty(0)
    lines = with_neighbours(*raw_lines(values))
    good, _, _ = marginals(field, lines)
    sums = np.add.reduceat(good * lines.length, lines.starts[:-1])
    return np.clip(sums / np.add.reduceat(lines.length, lines.starts[:-1]), 0.0, 1.0)


def scored(docs: DataFrame, field: Field, text_col: str = "text", out: str = "score") -> DataFrame:
    """The input's rows with all their columns and a score between 0 and 1. NULL texts score as empty ones."""
    bundled = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [document_scores(field, part) for part in _parts(texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate([np.empty(0), *scores]))], ["row", "score"]
            )

    schema = bundled.select("row", F.lit(0.0).alias("score")).schema
    return bundled.mapInArrow(work, schema).select("row.*", F.col("score").alias(out))


def _parts(values: list, size: int = 2_000) -> Iterator[list]:
    for start in range(0, len(values), size):
        yield values[start : start + size]


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row.

    The whole text is read line by line: a conditional random field with features of each line and both its
    neighbours labels every line good or bad, and the score is the mean of the lines' forward-backward
    marginals, weighted by length. ``predicted`` is 1 from ``threshold`` on. Ids enter only the fold:
    ``held_out`` rows, fold 0 of ``FOLDS``, are never learned from.

    NULL and empty texts score as one empty line. Repeated rows score alike. A NULL id is held out. Labels of
    other ids, NULL labels, and extra columns are ignored. An empty table gives an empty result.
    """
    field = fit(docs, labels, id_col, text_col, label_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    result = scored(narrow, field)
    return result.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), FOLDS) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
