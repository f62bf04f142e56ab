"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridprobe.llm.common import texts

SHINGLE = 5
SIMILARITY = 0.8
# Fingerprints of windows at the similarity differ in about ten bits; this is three deviations more.
RADIUS = 20
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
# Items searched for in one pass over the documents.
ITEMS = 20_000
# Hash of a word that no item has.
UNKNOWN = -1


@dataclass
class _Group:
    """Items of one length in words."""

    length: int
    items: np.ndarray  # places in the list of items
    marks: np.ndarray  # fingerprints
    tables: list[np.ndarray]  # per block: value -> which items are within the block's share of the radius


class Index:
    """A block of items, as the tasks use it."""

    def __init__(self, rows: list[Row]):
        self.ids = [row["id"] for row in rows]
        words = [row["text"].encode().lower().split() for row in rows]
        self.numbers: dict[bytes, int] = {}
        for item in words:
            for word in item:
                self.numbers.setdefault(word, len(self.numbers))
        self.hashes = word_hashes(list(self.numbers))
        self.items = [shingles(word_hashes(item)) if item else np.empty(0, np.uint64) for item in words]
        self.counts = [Counter(s.tolist()) for s in self.items]
        widths = [min(len(item), SHINGLE) for item in words]
        self.wanted = {
            n: np.unique(np.concatenate([s for s, w in zip(self.items, widths) if w == n])) for n in set(widths) - {0}
        }
        lengths = np.array([len(item) for item in words], np.int64)
        self.groups = [self._group(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths[lengths > 0])]

    def _group(self, length: int, items: np.ndarray) -> _Group:
        marks = simhashes(np.stack([self.items[i] for i in items]))
        near = BYTES_WITHIN[RADIUS // BLOCKS]
        tables = [near[:, (marks >> np.uint64(BLOCK_BITS * b)) & np.uint64(255)] for b in range(BLOCKS)]
        return _Group(length, items, marks, tables)

    def shared(self, words: list[bytes]) -> dict[int, np.ndarray]:
        """Per shingle width, a mark wherever a shingle of some item starts; widths without any are left out."""
        number = self.numbers.get
        code = np.fromiter(map(number, words, repeat(UNKNOWN)), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(code >= 0)))
        found = {}
        for width, wanted in self.wanted.items():
            if len(code) < width:
                continue
            spots = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(spots):
                continue
            there = np.zeros(len(code) - width + 1, np.int64)
            made = shingles(self.hashes[code[spots[:, None] + np.arange(width)]], width)[:, 0]
            there[spots[wanted[np.minimum(np.searchsorted(wanted, made), len(wanted) - 1)] == made]] = 1
            if there.any():
                found[width] = there
        return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)


def shingles(hashed: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``width`` words along the last axis; of a shorter sequence, that of the whole."""
    width = min(width, hashed.shape[-1])
    n = hashed.shape[-1] - width + 1
    out = np.full((*hashed.shape[:-1], n), width, np.uint64)
    for k in range(width):
        out += hashed[..., k : k + n] * _PLACE[k]
    return _mixed(out)


_PLACE = np.random.default_rng(5).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.arange(256)
_FAR = np.bitwise_count((_BYTE[:, None] ^ _BYTE[None, :]).astype(np.uint8))
BYTES_WITHIN = [_FAR <= r for r in range(BLOCK_BITS + 1)]


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (the finaliser of a 64-bit hash)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")


def _packed(ones: np.ndarray) -> np.ndarray:
    return np.packbits(ones, axis=-1, bitorder="little").view("<u8")[..., 0]


def simhashes(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint per row of shingle hashes: the bits set in over half of them."""
    return _packed(2 * _bits(hashes).sum(axis=1, dtype=np.int64) > hashes.shape[1])


def within(group: _Group, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, item) places with fingerprints at most ``RADIUS`` bits apart.

    Two such fingerprints differ by at most RADIUS / BLOCKS bits in one of the blocks, so looking each block up
    with that tolerance misses none; the whole distance is checked on what the blocks bring.
    """
    for start in range(0, len(marks), 4096):
        part = marks[start : start + 4096]
        hit = np.zeros((len(part), len(group.items)), bool)
        for b, table in enumerate(group.tables):
            hit |= table[(part >> np.uint64(BLOCK_BITS * b)) & np.uint64(255)]
        window, item = np.nonzero(hit)
        near = np.bitwise_count(part[window] ^ group.marks[item]) <= RADIUS
        yield window[near] + start, item[near]


def similarity(a: Counter, b: Counter) -> float:
    """Shingles in common over shingles in either, each weighed by how often it occurs."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (a.total() + b.total() - both) if a or b else 0.0


def search(index: Index, words: list[bytes]) -> Iterator[tuple[int, float, int]]:
    """(item, similarity, first word) of the best window per item that reaches the similarity.

    A window can reach it only if at least that part of the item's shingles start in it, so windows with fewer
    shared shingles need no fingerprint; of a text that shares none with any item nothing more is computed.
    """
    shared = index.shared(words)
    if not shared:
        return
    hashed = word_hashes(words)
    best: dict[int, tuple[float, int]] = {}
    for group in index.groups:
        width, length = min(SHINGLE, group.length), min(group.length, len(words))
        if width not in shared:
            continue
        runs = np.concatenate(([0], np.cumsum(shared[width])))
        held = length - width + 1
        needed = int(np.ceil(SIMILARITY * (group.length - width + 1) - 1e-9))
        starts = np.flatnonzero(runs[held:] - runs[: len(runs) - held] >= needed)
        if not len(starts):
            continue
        low, high = int(starts[0]), int(starts[-1]) + held
        inside = shingles(hashed[low : high + width - 1], width)
        sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(inside), axis=0, dtype=np.int32)))
        at = starts - low
        marks = _packed(2 * (sums[at + held] - sums[at]) > held)
        for windows, items in within(group, marks):
            for window, item in zip(windows.tolist(), group.items[items].tolist()):
                first = int(at[window])
                score = similarity(Counter(inside[first : first + held].tolist()), index.counts[item])
                if score >= SIMILARITY and score > best.get(item, (0.0, 0))[0]:
                    best[item] = (score, int(starts[window]))
    for item, (score, start) in sorted(best.items()):
        yield item, score, start


def _passes(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Index]:
    """The items in blocks of about ``ITEMS``, by a hash, so that what goes to the tasks is bounded."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEMS))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for number in range(blocks):
        yield Index(items.filter(block == number).orderBy("id", "text").collect())


def _pass(docs: DataFrame, index: Index, kind: str, item_kind: pa.DataType, item_sql: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [
                (row, held.value.ids[item], score, start)
                for row, text in enumerate(texts(batch.column("text"))) if text
                for item, score, start in search(held.value, text.lower().split())
            ]
            if hits:
                rows, items, scores, starts = zip(*hits)
                yield pa.record_batch({
                    "id": batch.column("id").take(pa.array(rows)), "item": pa.array(items, item_kind),
                    "similarity": pa.array(scores, pa.float64()), "start": pa.array(starts, pa.int64()),
                })

    return docs.mapInArrow(work, f"id {kind}, item {item_sql}, similarity double, start long")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item_id, similarity, start): which texts contain which items, one row per pair, with the best window.

    A window is as long as the item (the whole text, if that is shorter). Its similarity is that of the two
    bags of five-word shingles, weighted by how often they occur; ``SIMILARITY`` and more is a hit. Windows
    are found by SimHash fingerprints within ``RADIUS`` bits; see ``within`` and ``search``. Texts never move:
    the items go to the tasks, in passes of about ``ITEMS`` items, so that what is broadcast is bounded however many
    there are.

    Words are cut at ASCII white space and lower-cased in A-Z. NULL, empty and wordless texts match nothing, as
    documents or as items. Items of fewer than five words are one shingle. Equal items each match. Rows without
    an id are reported with a NULL id. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sql = dict(benchmark.dtypes)[item_id]
    arrow = pa.int64() if sql in ("bigint", "int", "smallint", "tinyint") else pa.string()
    found = None
    for index in _passes(benchmark, item_id, item_text):
        hits = _pass(rows, index, dict(rows.dtypes)["id"], arrow, "long" if arrow == pa.int64() else "string")
        found = hits if found is None else found.union(hits)
    return found.select(
        F.col("id").alias(id_col), F.col("item").cast(sql).alias("item_id"), "similarity", F.col("start").alias("start_word")
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows, with all their columns, whose text contains no item in the sense of ``contaminated``.

    Nothing is shuffled. NULL and empty texts are clean.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    for index in _passes(benchmark, item_id, item_text):
        rows = _without_hits(rows, index)
    return rows.select("row.*")


def _without_hits(rows: DataFrame, index: Index) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                not text or next(search(held.value, text.lower().split()), None) is None
                for text in texts(batch.column("text"))
            ]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(work, rows.schema)
