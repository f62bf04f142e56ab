"""Substring deduplication: sentences covered by a repeated run of sentences are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprobe.llm.common import stage

# A run holds at least so many sentences and words.
RUN_SENTENCES = 2
RUN_WORDS = 25
# A sentence of more words counts as several: it is cut before every word that, with the one before it, hashes to a
# multiple of CUT_ONE_IN, and after PIECE_WORDS at the latest.
SENTENCE_WORDS = 16
CUT_ONE_IN = 8
PIECE_WORDS = 24

_END = re.compile(r"[.!?][ \t]+|\n")
_WORD = re.compile(r"\S+")
# A span is one long: the first sentence, the number of sentences, and a mark of the text, in so many bits.
_COUNT_BITS, _MARK_BITS = 8, 28
# Documents whose runs are made at once.
LOT = 200


def sentences(text: str) -> tuple[list[int], list[list[str]]]:
    """Where the sentences start, and the lower-case words of each; together they are the whole text.

    A sentence ends with . ! or ? before white space, or with a line break, and takes the white space behind it
    along. One of more than ``SENTENCE_WORDS`` words is cut where two words say so, so that a passage is cut
    alike whatever stands before it.
    """
    starts: list[int] = []
    words: list[list[str]] = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        found = text[at:end].lower().split()
        if not found:
            continue  # white space goes to the next sentence
        if len(found) <= SENTENCE_WORDS:
            starts.append(at)
            words.append(found)
        else:
            # Lower case may change the number of characters, but never that of words.
            begins = [m.start() for m in _WORD.finditer(text, at, end)]
            cuts = [0, *_cuts(found)]
            starts += [at, *(begins[c] for c in cuts[1:])]
            words += [found[a:b] for a, b in zip(cuts, [*cuts[1:], len(found)])]
        at = end
    return starts, words


def _cuts(found: list[str]) -> list[int]:
    """The words before which a long sentence is cut."""
    out, last, digest = [], 0, xxhash.xxh32_intdigest
    for i in range(1, len(found)):
        if i - last >= PIECE_WORDS or not digest(f"{found[i - 1]} {found[i]}") % CUT_ONE_IN:
            out.append(i)
            last = i
    return out


def runs(n_words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(first, last) of the shortest run from every sentence onwards that has ``RUN_SENTENCES`` and ``RUN_WORDS``, in
    order. Every such run inside a passage lies wholly in it, and together they cover it from its first sentence to
    where the last one that fits ends. ``ends`` has the place behind the last sentence of each document; no run
    crosses it."""
    n = len(n_words)
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    total = np.concatenate(([0], np.cumsum(n_words)))
    at = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS, "left") - 1, at + RUN_SENTENCES - 1)
    inside = last < stop
    return np.stack((at[inside], last[inside]), 1)


_ODD = np.random.default_rng(64).integers(0, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_hashes(digests: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """128 bits per run: sums of the sentences' hashes times a multiplier per place, mixed with the length."""
    length = spans[:, 1] - spans[:, 0] + 1
    out = np.zeros((len(spans), 2), np.uint64)
    for step in range(int(length.max(initial=0))):
        inside = np.flatnonzero(length > step)
        out[inside] += digests[spans[inside, 0] + step] * _ODD[:, step % _ODD.shape[1]]
    out ^= out >> np.uint64(29)
    return (out + length.astype(np.uint64)[:, None]) * _ODD[:, 0]


def _mark(text: str) -> int:
    """Tells texts of rows with one id apart."""
    return xxhash.xxh32_intdigest(text) >> (32 - _MARK_BITS)


def _spans(place: np.ndarray, mark: np.ndarray) -> np.ndarray:
    if len(place) and place[:, 0].max() >= 1 << (63 - _COUNT_BITS - _MARK_BITS):
        raise ValueError("a text has too many sentences to number")
    count = place[:, 1] - place[:, 0] + 1
    return (place[:, 0] << (_COUNT_BITS + _MARK_BITS)) | (count << _MARK_BITS) | mark


def run_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, span, again) of every run of every document; span has its place and a mark of the text (see
    ``_spans``), and ``again`` tells that an earlier run of the same document is equal."""

    def lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column("text").to_pylist()
        for start in range(0, len(values), LOT):
            words, ends, marks = [], [], []
            for text in values[start : start + LOT]:
                words += sentences(text or "")[1]
                ends.append(len(words))
                marks.append(_mark(text or ""))
            digest = xxhash.xxh3_128_digest
            digests = np.frombuffer(b"".join([digest(" ".join(w)) for w in words]), "<u8").reshape(-1, 2)
            n_words = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.array(ends)
            found = runs(n_words, ends)
            if not len(found):
                continue
            hashed = run_hashes(digests, found)
            row = np.searchsorted(ends, found[:, 0], side="right")
            _, first_of = np.unique(np.column_stack((row.astype(np.uint64), hashed[:, 0])).view("u8,u8").ravel(), return_index=True)
            again = np.ones(len(found), bool)
            again[first_of] = False
            place = found - np.concatenate(([0], ends))[row][:, None]
            yield pa.record_batch({
                "h1": pa.array(hashed[:, 0].view(np.int64)), "h2": pa.array(hashed[:, 1].view(np.int64)),
                "id": batch.column("id").take(pa.array(row + start)),
                "span": pa.array(_spans(place, np.array(marks)[row])), "again": pa.array(again),
            })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from lots(batch)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return rows.mapInArrow(work, f"h1 long, h2 long, id {dict(rows.dtypes)['id']}, span long, again boolean")


def _cut(text: str, spans: list[int]) -> tuple[str, int, int]:
    """The text without the sentences of the runs, how many these are, and their words."""
    starts, words = sentences(text)
    gone = np.zeros(len(starts) + 1, np.int64)
    mark = _mark(text)
    for span in spans:
        # Rows that share an id but not a text have marks of their own.
        if span & ((1 << _MARK_BITS) - 1) == mark:
            first = span >> (_COUNT_BITS + _MARK_BITS)
            gone[first] += 1
            gone[first + (span >> _MARK_BITS & ((1 << _COUNT_BITS) - 1))] -= 1
    gone = np.cumsum(gone)[: len(starts)] > 0
    ends = [*starts[1:], len(text)]
    kept = [text[a:b] for a, b, out in zip(starts, ends, gone.tolist()) if not out]
    return "".join(kept), int(gone.sum()), sum(len(w) for w, out in zip(words, gone.tolist()) if out)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_removed, words_removed): texts without sentences that a repeated run covers.

    See ``cut_rows``. One row per input row; other columns are ignored.
    """
    cut = cut_rows(docs.select(id_col, text_col), id_col, text_col)
    return cut.select(f"row.{id_col}", F.col("text").alias(text_col), "n_removed", "words_removed")


def cut_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_removed, words_removed): all other columns in ``row``, and the text without
    the sentences that a repeated run covers.

    A run is several consecutive sentences (see ``runs``). Among its occurrences in all documents, the one
    with the least (id, place) stays and the sentences of all others go; so of a passage that many documents
    share, and of whole copies, one is left. Only counts and first places are shuffled per run, so a run that
    is everywhere is a sum like any other; its occurrences join back on the hash. Sentences compare without
    case and spacing.

    NULL texts stay NULL, empty ones empty. Rows without an id keep their text and take no part. Rows that
    repeat an id lose their own sentences only, equal rows the same ones; a run that several rows of the least
    id have stays in all of them. An empty table gives an empty result.
    """
    spans = stage(run_table(docs, id_col, text_col), "runs")
    # A run counts once per document here, so that the least id alone tells which occurrence is the first.
    once = spans.filter("NOT again").select("h1", "h2", "id", "span")
    repeated = stage(
        once.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1").select("h1", "h2", "first"), "repeated",
    )
    later = once.join(repeated, ["h1", "h2"]).filter(F.col("id") != F.col("first")).select("id", "span")
    # One list per id, no longer than the documents that have it.
    lists = later.union(spans.filter("again").select("id", "span")).groupBy("id").agg(F.collect_list("span").alias("spans"))
    lists = lists.withColumnRenamed("id", "cut_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _cut(text, spans) if text and spans else (text, 0, 0)
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            ]
            kept, removed, words = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.string()), pa.array(removed, pa.int32()), pa.array(words, pa.int64())],
                ["row", "text", "n_removed", "words_removed"],
            )

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(lists, rows["id"] == lists["cut_id"], "left").select("row", "text", "spans")
    shape = rows.select(
        "row", "text", F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("words_removed")
    ).schema
    return joined.mapInArrow(work, shape)
