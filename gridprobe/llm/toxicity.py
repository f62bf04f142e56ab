"""Toxicity of texts whose spelling may be disguised: noisy-channel decoding, then scoring of what was meant."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.llm.common import blob_rows, fold_of, hash_share, labelled_sample, release, stage

FOLDS = 5
# Labelled documents the weights are learned from, in expectation; the last part calibrates the score.
SAMPLE = 20_000
LEARNING_SHARE = 0.75

# Symbols of the character model: 0 is everything that is no letter, the last is any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SYMBOLS = len(LETTERS) + 2
OTHER = SYMBOLS - 1
_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
_SMOOTHING = 0.05

# The channel: what a sign may stand for, and the log-probability of writing it so.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "(": "c", "|": "il", "*": "aeiou",
}
WRITTEN = {
    "sign": -1.5, "unread": -7.0, "edge": -0.5, "noise": -2.5, "repeat": -1.0, "doubled": -4.6, "spaced": -0.2, "apart": -1.5,
}
# Signs around a word that are mostly no part of its spelling; those that never are.
_EDGES = ".,;:?\"'()[]{}<>-–—_%&*#!|~`^/\\="
_OUTSIDE = "".join(c for c in _EDGES if c not in LEET)
# Signs that punctuation does not put before a word, and behind one.
_NOT_BEFORE, _NOT_BEHIND = "!", "("
_TWICE = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def symbols(text: str) -> np.ndarray:
    """The symbols of a lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = _table()
    low = points < len(table)
    out = np.where(low, table[np.where(low, points, 0)], 0)
    for at in np.flatnonzero(~low):
        out[at] = OTHER if text[at].isalpha() else 0
    return out


def _table(size: int = 0x250, held: list = []) -> np.ndarray:  # noqa: B006  (computed once)
    if not held:
        held.append(np.array([_SYMBOL.get(chr(c), OTHER if chr(c).isalpha() else 0) for c in range(size)], np.int64))
    return held[0]


def trigram_counts(values: Iterable[str | None], chunk: int = 1 << 20) -> np.ndarray:
    """How often each symbol follows each pair of symbols, all texts set apart by non-letters."""
    counts = np.zeros(SYMBOLS**3)
    held, size = [], 0
    def flush() -> None:
        code = symbols("\n\n".join(["", *held, ""]).lower())
        triple = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
        # Runs of non-letters say nothing about words.
        triple = triple[(code[2:] > 0) | (code[1:-1] > 0)]
        counts[:] += np.bincount(triple, minlength=SYMBOLS**3)
    for text in values:
        if text:
            held.append(text)
            size += len(text)
            if size > chunk:
                flush()
                held, size = [], 0
    if held:
        flush()
    return counts


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(symbol | two before) from all texts; a table of fixed size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3)
        for batch in batches:
            total += trigram_counts(batch.column("text").to_pylist())
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    counts = blob_rows(docs.select(F.col(text_col).alias("text")).mapInArrow(work, "part binary"))
    counts = np.zeros(SYMBOLS**3) if counts is None else counts
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + _SMOOTHING
    return np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per place what may have been meant: letters with the log-probability of writing them as seen.

    A sign stands for one of its letters or for nothing; one written three times or more is noise. At the ends of
    a token standing for nothing is likelier, as that is where punctuation is. A letter written twice was meant
    twice or, less likely, once; one written three times or more was meant once or twice. A space between single
    characters was meant or not.
    """
    first, last = len(token) - len(token.lstrip(_EDGES)), len(token.rstrip(_EDGES))
    places, at = [], 0
    while at < len(token):
        c, run = token[at], 1
        while at + run < len(token) and token[at + run] == c:
            run += 1
        edge = (at < first and c not in _NOT_BEFORE) or (at >= last and c not in _NOT_BEHIND)
        at += run
        if c == " ":
            places.append([(" ", WRITTEN["apart"]), ("", WRITTEN["spaced"])])
        elif c.isalpha():
            if run == 1:
                places.append([(c, 0.0)])
            elif run == 2:
                places.append([(c * 2, 0.0), (c, WRITTEN["doubled"])])
            else:
                places.append([(c, WRITTEN["repeat"]), (c * 2, WRITTEN["repeat"])])
        else:
            letters = LEET.get(c, "") if run < 3 else ""
            meant = [("", WRITTEN["edge" if edge else "unread" if letters else "noise"])]
            meant += [(letter * run, WRITTEN["sign"]) for letter in letters]
            if run == 2:
                meant += [(letter, WRITTEN["sign"] + WRITTEN["doubled"]) for letter in letters]
            places.append(meant)
    return places


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest text behind a token (Viterbi over its lattice under the character model).

    States point back to the one they came from, so time and memory are linear in the token. Of equally likely
    texts it is the one whose path was found first.
    """
    cost_of = model.item
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for alternatives in [*lattice(token), [(" ", 0.0)]]:
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in best.items():
            for letters, cost in alternatives:
                total, x, y = score + cost, a, b
                for letter in letters:
                    z = _SYMBOL.get(letter, 0 if letter == " " else OTHER)
                    total, x, y = total + cost_of(x, y, z), y, z
                held = following.get((x, y))
                if held is None or total > held[0]:
                    following[x, y] = (total, (back, letters) if letters else back)
        best = following
    parts, back = [], max(best.values(), key=lambda state: state[0])[1]
    while back is not None:
        back, letters = back
        parts.append(letters)
    return "".join(reversed(parts)).strip()


def meant(token: str, model: np.ndarray) -> str:
    """What a lower-case token stands for. Letters none of which is written twice have a lattice with one path;
    signs that only stand around words mean nothing by themselves."""
    core = token.strip(_OUTSIDE)
    if core.isalpha() and not _TWICE.search(core):
        return core
    return decode(core, model) if core.strip(_EDGES) else ""


def features(word: str) -> list[str]:
    """A word, its beginnings, and its ending."""
    marks = [word] if len(word) > 2 else []
    marks += [f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n]
    if len(word) > 5:
        marks.append(f"-{word[-5:]}")
    return marks


class _Strengths(dict):
    """The largest weight of what a token means, for every token asked for."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        super().__init__()
        self.model, self.weights = model, weights

    def __missing__(self, token: str) -> float:
        get = self.weights.get
        found = self[token] = max((get(f, 0.0) for w in meant(token, self.model).split() for f in features(w)), default=0.0)
        return found

    def __reduce__(self):
        return _Strengths, (self.model, self.weights)


@dataclass
class Scorer:
    """Weights of features, and how a document's strongest ones make its score."""

    model: np.ndarray
    weights: dict[str, float]
    line: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 0.0]))

    def __post_init__(self) -> None:
        self._strengths = _Strengths(self.model, self.weights)

    def words(self, text: str) -> set[str]:
        """The distinct words meant by a text."""
        low = text.lower()
        tokens = {w for t in set(low.split()) for w in meant(t, self.model).split()}
        for run in _SPACED.findall(low):
            tokens.update(decode(" ".join(run.split()), self.model).split())
        return tokens

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """(1, strongest weight, logarithm of how many words carry one)."""
        if not text:
            return 1.0, 0.0, 0.0
        if len(self._strengths) > 400_000:
            self._strengths.clear()
        low = text.lower()
        known = [s for s in map(self._strengths.__getitem__, set(low.split())) if s]
        for run in _SPACED.findall(low):
            for word in decode(" ".join(run.split()), self.model).split():
                if (s := self._strengths[word]):
                    known.append(s)
        return 1.0, max(known, default=0.0), float(np.log1p(len(known)))

    def scores(self, values: list[str | None]) -> np.ndarray:
        rows = np.array([self.evidence(v) for v in values], np.float64).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(rows @ self.line, -40, 40)))


def _weights(sample: DataFrame, model: np.ndarray) -> dict[str, float]:
    """log of how much likelier a feature is in toxic documents; those that could well be chance have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, {})
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("sample_label").to_pylist()):
                seen[label > 0].update({f for w in scorer.words(text or "") for f in features(w)})
            marks = list(seen[0] | seen[1])
            yield pa.record_batch({
                "feature": pa.array(marks, pa.string()), "clean": pa.array([seen[0][m] for m in marks], pa.int64()),
                "toxic": pa.array([seen[1][m] for m in marks], pa.int64()),
            })

    sizes = {row["toxic"]: row["n"] for row in sample.groupBy((F.col("sample_label") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        return {}
    counts = sample.mapInArrow(work, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    both = F.col("clean") + F.col("toxic")
    part = lambda seen, of: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) * (n0 + n1) / (both * of))).otherwise(0.0)
    surprise = 2 * (part("clean", float(n0)) + part("toxic", float(n1)))
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1.0) / ((F.col("clean") + 0.5) / (n0 + 1.0)))
    # The sample is bounded, so are its features.
    kept = counts.filter("toxic >= 3").withColumn("weight", weight).filter((F.col("weight") > 1.5) & (surprise > 20.0))
    return {row["feature"]: row["weight"] for row in kept.select("feature", "weight").collect()}


def _calibrated(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    line = np.zeros(rows.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -40, 40)))
        slope = rows.T @ (labels - p) - 1e-2 * line
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(len(line))
        step = np.linalg.solve(bend, slope)
        line = line + step
        if np.abs(step).max() < 1e-8:
            break
    return line


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", folds: int = FOLDS, bound: int = SAMPLE) -> Scorer:
    """Learns from labelled documents outside fold 0, ``bound`` of them in expectation; the character model
    reads all texts. With labels of one kind only, every score is that of a text without evidence."""
    model = character_model(docs, text_col)
    wanted = labelled_sample(labels, label_col, folds, bound)
    rows = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(wanted, "sample_id")
    sample = stage(rows.withColumn("learns", hash_share(F.concat_ws(":", F.lit("part"), F.col("sample_id").cast("string"))) < LEARNING_SHARE), "sample")
    scorer = Scorer(model, _weights(sample.filter("learns").select("text", "sample_label"), model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([scorer.evidence(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 3)
            yield pa.record_batch({
                "strongest": pa.array(found[:, 1]), "many": pa.array(found[:, 2]), "label": batch.column("sample_label"),
            })

    held = sample.filter("NOT learns").select("text", "sample_label")
    # A row of numbers for each of a bounded number of documents.
    told = held.mapInArrow(work, "strongest double, many double, label int").toPandas().sort_values(["label", "strongest", "many"])
    release(sample)
    if told["label"].nunique() == 2:
        rows = np.column_stack([np.ones(len(told)), told["strongest"], told["many"]])
        scorer.line = _calibrated(rows, told["label"].to_numpy(np.float64))
    return scorer


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row.

    Every token of the whole text is decoded to the letters it was most likely meant as, through signs that
    stand for letters, noise between them, letters drawn out, and spaced-out words. A document's score comes
    from the words so restored. Ids enter only the fold: ``held_out`` rows, fold 0 of ``FOLDS``, are never
    learned from; their texts count in the character model, which knows no labels.

    NULL and empty texts score as texts without evidence. A token of any length is decoded whole, in time linear in
    it. Repeated rows score alike. A NULL id is held out.
    Labels of other ids, NULL labels, and extra columns are ignored. An empty table gives an empty result.
    """
    scorer = fit(docs, labels, id_col, text_col, label_col)
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores(batch.column("text").to_pylist())
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(scores)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    result = rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, score double")
    return result.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), FOLDS) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
