"""Language-model scores from a hidden Markov model over word classes."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.llm.common import blob_rows, fold_of, stage, texts

FOLDS = 7
HELD_OUT = 2
STATES = 8
ITERATIONS = 6
# Words with at least 1 / FREQUENT of all tokens are a class of their own: at most FREQUENT words.
FREQUENT = 2_000
# Their number bounds the words whose counts every task holds; the counts of all others are joined.
HELD_WORDS = 500_000
# All other words fall into this many classes, by the crc32 of their last four bytes.
SHAPES = 1_024
END = b""
# Tokens whose chains are run at once.
CHAINS = 1 << 19
# Training cuts texts into windows of so many tokens, and runs the chain over so many more on either side of each.
WINDOW = 512
CONTEXT = 128


@dataclass
class Counts:
    """What the training tokens say: totals, and counts of the words that are common enough to be held."""

    tokens: int
    distinct: int
    held: dict[bytes, int]
    own: dict[bytes, int]  # word -> class, of the most frequent
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.class_tokens)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the texts of the column ``text``; each text ends with the token ``END``.

    Tasks add up before the shuffle, whenever they hold half a million words.
    """

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(counts), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            values = texts(batch.column("text"))
            for text in values:
                counts.update((text or b"").lower().split())
                if len(counts) > HELD_WORDS:
                    yield emit(counts)
                    counts = Counter()
            if values:
                counts[END] += len(values)
        if counts:
            yield emit(counts)

    return rows.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def summed_up(words: DataFrame) -> Counts:
    """The bounded part of a table of counts."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0]), int(total[1])
    # No more than HELD_WORDS words can have 1 / HELD_WORDS of the tokens each. The end has a class of its own, however rare.
    common = words.filter((F.col("n") >= tokens / HELD_WORDS) | (F.col("word") == END)).collect()
    held = {bytes(row["word"]): row["n"] for row in common}
    frequent = sorted(w for w, n in held.items() if n >= tokens / FREQUENT or w == END)
    own = {w: i for i, w in enumerate([*frequent, *([END] if END not in frequent else [])])}
    ending = F.expr("substring(word, greatest(length(word) - 3, 1), 4)")
    rest = words.filter(~F.col("word").isin(*own)) if own else words
    shapes = rest.groupBy(F.pmod(F.crc32(ending), F.lit(SHAPES)).alias("shape")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")
    )
    class_tokens, class_words = np.zeros(len(own) + SHAPES), np.zeros(len(own) + SHAPES)
    for word, place in own.items():
        class_tokens[place], class_words[place] = held.get(word, 0), float(word in held)
    for row in shapes.collect():
        class_tokens[len(own) + row["shape"]], class_words[len(own) + row["shape"]] = row["n"], row["distinct"]
    return Counts(tokens, distinct, held, own, class_tokens, class_words)


class _Numbers(dict):
    """Numbers words as they come, with the class of each and log10(count + 1), or -1 where that is not held."""

    def __init__(self, counts: Counts):
        super().__init__()
        self.held, self.own, self.first_shape = counts.held, counts.own, len(counts.own)
        self.words, self.classes, self.logs = [], array("h"), array("d")

    def __missing__(self, word: bytes) -> int:
        n = self.held.get(word)
        number = self[word] = len(self.words)
        self.words.append(word)
        if n is None:
            # No frequent word is missing among the held ones, so this one has the class of its ending.
            self.classes.append(self.first_shape + crc32(word[-4:]) % SHAPES if word else self.own[END])
            self.logs.append(-1.0)
        else:
            place = self.own.get(word)
            self.classes.append(self.first_shape + crc32(word[-4:]) % SHAPES if place is None else place)
            self.logs.append(log10(n + 1))
        return number


def encoded(rows: DataFrame, counts: Counts) -> DataFrame:
    """Per text of (id, held_out, text): its classes as 16-bit numbers, sums over tokens whose counts are held,
    and the other words with how often each occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        inside = np.log10(c.class_tokens + c.class_words + 1)
        numbers = _Numbers(c)
        kinds = {"seq": pa.binary(), "n_tokens": pa.int64(), "n_known": pa.int64(), "log_counts": pa.float64(),
                 "log_classes": pa.float64(), "words": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}
        for batch in batches:
            values = texts(batch.column("text"))
            for start in range(0, len(values), 500):
                out: dict[str, list] = {k: [] for k in kinds}
                if len(numbers) > HELD_WORDS:
                    numbers = _Numbers(c)
                lot = [[*(text or b"").lower().split(), END] for text in values[start : start + 500]]
                codes = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in lot]
                classes, logs = np.array(numbers.classes), np.array(numbers.logs)
                for code in codes:
                    seq, log = classes[code], logs[code]
                    held = log >= 0
                    rare, times = np.unique(code[~held], return_counts=True)
                    row = (seq.tobytes(), len(seq), int(held.sum()), float(log[held].sum()), float(inside[seq].sum()),
                           [numbers.words[i] for i in rare.tolist()], times.tolist())
                    for k, value in zip(out, row):
                        out[k].append(value)
                part = batch.slice(start, 500)
                yield pa.record_batch({"id": part.column("id"), "held_out": part.column("held_out")} | {
                    k: pa.array(out[k], kinds[k]) for k in kinds
                })

    return rows.mapInArrow(
        work, f"id {kind}, held_out boolean, seq binary, n_tokens long, n_known long, log_counts double, "
        "log_classes double, words array<binary>, times array<int>",
    )


# --- the chain --------------------------------------------------------------------------------


@dataclass
class Chain:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state, next state]
    emit: np.ndarray  # [class, state]

    @staticmethod
    def initial(frequencies: np.ndarray, states: int = STATES) -> Chain:
        """Each state prefers other classes, at random but the same every time, and states tend to stay."""
        rng = np.random.default_rng(10)
        emit = (frequencies[:, None] + 1e-9) * np.exp(rng.normal(0.0, 1.0, (len(frequencies), states)))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9)
        return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def parts(self) -> list[np.ndarray]:
        return [self.start, self.move, self.emit]


@dataclass
class Windows:
    """Windows with their context as one table [time, window], longest first. Tokens from ``since`` to before
    ``until`` are the window's own; ``begins`` tells windows at the start of a text."""

    table: np.ndarray
    length: np.ndarray
    since: np.ndarray
    until: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return self.since == 0

    @staticmethod
    def of(seqs: list[np.ndarray]) -> Windows:
        pieces = []
        for s in seqs:
            for a in range(0, len(s), WINDOW):
                low = max(a - CONTEXT, 0)
                pieces.append((s[low : a + WINDOW + CONTEXT], a - low, min(a + WINDOW, len(s)) - low))
        pieces.sort(key=lambda piece: len(piece[0]), reverse=True)
        length, since, until = (np.array(v) for v in zip(*((len(p), a, b) for p, a, b in pieces)))
        table = np.zeros((length[0], len(pieces)), np.int16)
        for i, (p, _, _) in enumerate(pieces):
            table[: len(p), i] = p
        return Windows(table, length, since, until)

    def own(self, t: int, k: int) -> np.ndarray | None:
        """Which of the first ``k`` windows have the token at ``t`` as their own; None for all."""
        inside = (self.since[:k] <= t) & (t < self.until[:k])
        return None if inside.all() else inside


def settled(move: np.ndarray) -> np.ndarray:
    """The shares of states that moves leave as they are."""
    return np.full(len(move), 1 / len(move)) @ np.linalg.matrix_power(move, 1 << 12)


def expected_counts(chain: Chain, seqs: list[np.ndarray]) -> np.ndarray:
    """One Baum-Welch step's expected starts, moves and emissions, with the log10 probability of the texts.

    Texts of up to ``WINDOW`` tokens are run whole. Windows of longer ones read ``CONTEXT`` tokens on either side, of
    which only the state at their borders is kept: moves across borders count, and starts count where texts start.
    """
    windows = Windows.of(seqs)
    table, length, begins = windows.table, windows.length, windows.begins
    steps, states = len(table), len(chain.start)
    active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    # States are rows, so that every step works along long rows; single precision is ample for expected counts.
    move = chain.move.astype(np.float32)
    emit = np.ascontiguousarray(chain.emit.T, np.float32)
    seen = [np.take(emit, table[t, :k], axis=1) for t, k in enumerate(active)]
    turn = np.ascontiguousarray(move.T)
    first = np.where(begins, chain.start[:, None], settled(chain.move)[:, None]).astype(np.float32)
    fore, shrink, reached = [], [], 0.0
    for t, k in enumerate(active):
        a = (turn @ fore[-1][:, :k] if t else first) * seen[t]
        shrink.append(1 / a.sum(axis=0))
        a *= shrink[-1]
        fore.append(a)
        own = windows.own(t, k)
        reached -= float(np.log10(shrink[-1] if own is None else shrink[-1][own], dtype=np.float64).sum())
    moves = np.zeros((states, states))
    back = np.ones((states, active[-1]), np.float32)
    gammas = [None] * steps
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if back.shape[1] < k:
            back = np.hstack([back, np.ones((states, k - back.shape[1]), np.float32)])
        own = windows.own(t, k)
        gammas[t] = fore[t] * back if own is None else fore[t] * back * own
        if t:
            ahead = seen[t] * back
            ahead *= shrink[t]
            moves += fore[t - 1][:, :k] @ (ahead if own is None else ahead * own).T
            back = move @ ahead
    starts = gammas[0][:, begins].sum(axis=1)
    order = np.concatenate([table[t, :k] for t, k in enumerate(active)])
    gamma = np.concatenate(gammas, axis=1)
    emits = np.stack([np.bincount(order, gamma[s], minlength=emit.shape[1]) for s in range(states)], axis=1)
    return np.concatenate((starts, (moves * chain.move).ravel(), emits.ravel(), [reached]))


def sequence_scores(chain: Chain, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence of classes, by the scaled forward recursion."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    length = np.array([len(seqs[i]) for i in order])
    starts = np.concatenate(([0], np.cumsum(length)[:-1]))
    flat = np.concatenate([seqs[i] for i in order]) if order else np.empty(0, np.int16)
    active = np.searchsorted(-length, -np.arange(1, (length[0] if order else 0) + 1), side="right")
    reached, state = np.zeros(len(order)), None
    turn, emit = np.ascontiguousarray(chain.move.T), np.ascontiguousarray(chain.emit.T)
    for t, k in enumerate(active):
        a = (turn @ state[:, :k] if t else chain.start[:, None]) * np.take(emit, flat[starts[:k] + t], axis=1)
        total = a.sum(axis=0)
        reached[:k] += np.log10(total)
        a /= total
        state = a
    out = np.empty(len(order))
    out[order] = reached
    return out


def _batched(batches: Iterator[pa.RecordBatch], size_of_lot: int, *columns: str) -> Iterator[list[list]]:
    """Values of columns, the first a sequence, in lots of about so many tokens."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            seq = np.frombuffer(row[0], np.int16)
            for values, value in zip(held, (seq, *row[1:])):
                values.append(value)
            size += len(seq)
            if size >= size_of_lot:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def trained(coded: DataFrame, counts: Counts, iterations: int = ITERATIONS) -> Chain:
    """Baum-Welch over all training texts: tasks return expected counts, which are added up in two rounds."""
    n = counts.classes
    chain = Chain.initial((counts.class_tokens + 1e-3) / (counts.class_tokens.sum() + 1e-3 * n))
    training = coded.filter("NOT held_out").select("seq")
    for _ in range(iterations):
        shared = coded.sparkSession.sparkContext.broadcast(chain)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for (seqs,) in _batched(batches, CHAINS, "seq"):
                part = expected_counts(shared.value, seqs)
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

        sums = blob_rows(training.mapInArrow(work, "part binary"))
        shared.unpersist()
        if sums is None:
            break
        k = len(chain.start)
        starts, moves, emits = sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k : -1].reshape(n, k)
        moves, emits = moves + 1e-3, emits + 1e-3
        starts = starts + 1e-3
        chain = Chain(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return chain


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
           held_fold: int = HELD_OUT, iterations: int = ITERATIONS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Tokens are the words of the whole text (cut at ASCII white space, A-Z lower-cased) and one end. The model
    learns from texts outside the held-out fold. A token's probability is that of its class given the hidden
    states, which Baum-Welch trains over all training texts, times (c + 1) / (N + V + 1) within the class, so
    that unknown words have a share in each. ``score`` is the log10 of the text's probability, summed over all
    state paths by the scaled forward recursion. ``base_score`` is the add-one unigram score.

    Counts of words are exact: those that 1 / HELD_WORDS of all tokens are, a number bounded by HELD_WORDS,
    go to every task, and all others are joined by word, once per text and word.

    NULL and empty texts are an end token. Rows that repeat an id are separate texts. A NULL id counts as
    fold 0. Without training texts every count is zero and the scores are finite. Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), (fold_of(F.col(id_col), folds) == held_fold).alias("held_out"), F.col(text_col).alias("text")
    )
    words = stage(word_counts(rows.filter("NOT held_out").select("text")), "words")
    counts = summed_up(words)
    # Written once, so that the numbers of rows below stay the same wherever they are read.
    coded = stage(encoded(rows, counts).withColumn("row", F.monotonically_increasing_id()), "encoded")
    chain = trained(coded, counts, iterations)

    pairs = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("pair")).select(
        "row", F.col("pair.words").alias("word"), F.col("pair.times").alias("times")
    )
    rare = words.filter((F.col("n") < counts.tokens / HELD_WORDS) & (F.col("word") != END))
    found = pairs.join(rare, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"), F.sum("times").alias("rare_known")
    )
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seqs, ids in _batched(batches, 4 * CHAINS, "seq", "row"):
            yield pa.record_batch({"row": pa.array(ids, pa.int64()), "chain": pa.array(sequence_scores(shared.value, seqs))})

    chained = coded.select("seq", "row").mapInArrow(work, "row long, chain double")
    both = coded.drop("seq", "words", "times").join(chained, "row").join(found, "row", "left").fillna(0, ["rare_logs", "rare_known"])
    logs = F.col("log_counts") + F.col("rare_logs")
    size = float(np.log10(counts.tokens + counts.distinct + 1))
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * size).alias("base_score"), (F.col("chain") + logs - F.col("log_classes")).alias("score"),
    )
