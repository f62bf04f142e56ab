"""Byte-level BPE: pre-tokens of overlapping chunks, stitched where they resynchronise, then merged and decoded."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridprobe.llm.common import stage, texts

# Texts of more bytes are cut into chunks of so many characters, each of which sees so many of the next one too.
CHUNK = 16_384
OVERLAP = 256
# A pre-token that ends so near to the end of what a chunk sees might end elsewhere if more were seen.
MARGIN = 4
# Pre-tokens whose ids a worker remembers.
REMEMBERED = 400_000
# Pre-tokens of more bytes are merged with a heap.
SHORT = 32


@dataclass
class Vocabulary:
    """Byte strings with their ranks, which are their ids, and the pattern of pre-tokens (without groups)."""

    ranks: dict[bytes, int]
    pattern: str

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    @property
    def kind(self) -> np.dtype:
        """The narrowest type that holds an id; ids travel in it between tasks."""
        return np.min_scalar_type(max(self.ranks.values()))

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def ids(self) -> _Ids:
        """What this process remembers; tasks of one worker share it."""
        return _Ids(self.ranks, self.kind)


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """Read a file of lines "base64 rank": a path of the driver, or a URI that Spark opens."""
    if "://" in path:
        content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    else:
        with open(path, "rb") as file:
            content = file.read()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"{path} has no rank for the bytes {lacking[:5]}, so some texts could not be encoded")
    return Vocabulary(ranks, pattern)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbours whose union has a rank, those of the least rank join, the
    leftmost first, until none are left. A pre-token that has a rank itself is that id."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > SHORT:
        return _merged_long(piece, ranks)
    get, none = ranks.get, len(ranks) + (1 << 32)
    at = list(range(len(piece) + 1))  # where the parts start
    joins = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while joins and (least := min(joins)) < none:
        i = joins.index(least)
        del at[i + 1], joins[i]
        if i < len(joins):
            joins[i] = get(piece[at[i] : at[i + 2]], none)
        if i:
            joins[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n: the part that starts at i ends at ``end[i]``, and the heap has (rank, start, end) of unions."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle is None or middle >= n or end[middle] != stop:
            continue  # one of the two has joined another since
        end[i], end[middle] = stop, None
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (first := before[i]) >= 0 and (rank := ranks.get(piece[first:stop])) is not None:
            heapq.heappush(heap, (rank, first, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Ids(dict):
    """The ids of pre-tokens in the narrow type, remembered up to a number."""

    def __init__(self, ranks: dict[bytes, int], kind: np.dtype):
        super().__init__()
        self.ranks, self.kind = ranks, kind

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(merged(raw, self.ranks), self.kind).tobytes()
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _encoder(shared):
    """(findall, encode) of a broadcast vocabulary, in a task."""
    words: Vocabulary = shared.value
    ids = words.ids
    return regex.compile(words.pattern).findall, lambda pieces: b"".join(map(ids.__getitem__, pieces))


def _wide(ids: bytes, kind: np.dtype) -> bytes:
    return np.frombuffer(ids, kind).astype("<u4").tobytes()


def _short(rows: DataFrame, shared) -> DataFrame:
    """(row, ids) of texts that need no cutting."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (findall, encode), kind = _encoder(shared), shared.value.kind
        for batch in batches:
            ids = [_wide(encode(findall(_text(value))), kind) for value in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary())], ["row", "ids"])

    return rows.mapInArrow(work, rows.select("row", F.lit(b"").alias("ids")).schema)


def chunks(rows: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(n, k, row, text, last): the k-th chunk of the n-th text with its overlap; ``row`` is with the first one only."""
    numbered = rows.select(F.monotonically_increasing_id().alias("n"), "row", "text")
    kind = numbered.select("row").schema[0]
    shape = numbered.select("n", F.lit(0).alias("k"), "row", "text", F.lit(True).alias("last")).schema
    shape["row"].nullable = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in enumerate(texts(batch.column("text"))):
                text, row = _text(value), batch.column("row").slice(at, 1)
                starts = range(0, max(len(text), 1), chunk)
                # A few at a time, so that a huge text is not held twice.
                for first in range(0, len(starts), 256):
                    part = starts[first : first + 256]
                    size = len(part)
                    rest = pa.nulls(size - (first == 0), row.type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("n")[at].as_py()] * size, pa.int64()),
                         pa.array(range(first, first + size), pa.int32()),
                         pa.concat_arrays([row, rest]) if first == 0 else rest,
                         pa.array([text[a : a + chunk + overlap] for a in part], pa.string()),
                         pa.array([a == starts[-1] for a in part], pa.bool_())],
                        ["n", "k", "row", "text", "last"],
                    )

    assert kind.name == "row"
    return numbered.mapInArrow(work, shape)


def _boundaries(lengths: np.ndarray, size: int, open_end: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Where pre-tokens start or end in the first ``overlap`` characters of a chunk, and in those of the next chunk
    that it sees; those too near to an end that is not the text's own are left out."""
    at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    if open_end:
        at = at[at <= size - MARGIN]
    return at[at <= overlap].tolist(), (at[at >= chunk] - chunk).tolist()


def _pre_tokenised(cut: DataFrame, shared, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(n, k, row, text, last, lengths, head, tail): each chunk on its own, wherever it lies."""
    shape = cut.select(
        "*", F.lit(b"").alias("lengths"), F.array(F.lit(0)).alias("head"), F.array(F.lit(0)).alias("tail")
    ).schema

    narrow = np.min_scalar_type(chunk + overlap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, _ = _encoder(shared)
        for batch in batches:
            out = []
            for text, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist()):
                lengths = np.fromiter(map(len, findall(text)), narrow)
                reaches = last or len(text) < chunk + overlap
                out.append((lengths.tobytes(), *_boundaries(lengths, len(text), not reaches, chunk, overlap)))
            lengths, head, tail = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lengths, pa.binary()), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))],
                [*batch.schema.names, "lengths", "head", "tail"],
            )

    return cut.mapInArrow(work, shape)


def seams(cut: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(n, k, begin, stop, whole): which characters of its chunk a piece has, from the first boundary that a chunk
    shares with the one before to the first that it shares with the next. Matching goes on from a boundary in the
    same way whatever came before, so from there on both agree. ``whole`` marks texts where two neighbours share
    none, since a pre-token is longer than the overlap: these are matched again in one go."""
    by_chunk = Window.partitionBy("n").orderBy("k")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(by_chunk)))
    met = cut.select("n", "k", "last", F.when(F.col("k") == 0, 0).otherwise(shared).alias("begin"))
    following = F.lead("begin").over(by_chunk)
    lost = F.max(F.col("begin").isNull()).over(Window.partitionBy("n"))
    return met.select(
        "n", "k", "begin", F.when(~F.col("last"), chunk + following).alias("stop"), lost.alias("whole")
    )


def pieces(cut: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(n, k, row, text, lengths): texts that can be encoded one by one; without ``lengths`` they are still to be matched."""
    found = cut.drop("head", "tail", "last").join(seams(cut, chunk), ["n", "k"])
    # One text is one row of the input, so the chunks of one are never more than that.
    whole = (
        found.filter("whole").groupBy("n")
        .agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("all"))
        .select("n", F.lit(0).alias("k"), "row",
                F.array_join(F.transform("all", lambda x: F.substring(x["text"], 1, chunk)), "").alias("text"),
                F.lit(None).cast("binary").alias("lengths"), F.lit(0).alias("begin"), F.lit(None).cast("int").alias("stop"))
    )
    return found.filter("NOT whole").select(*whole.columns).unionByName(whole)


def _long(rows: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) of texts that are cut into chunks."""
    narrow = np.min_scalar_type(chunk + overlap)
    spread = chunks(rows, chunk, overlap).repartition("n", "k")
    cut = stage(_pre_tokenised(spread, shared, chunk, overlap), "chunks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, encode = _encoder(shared)
        for batch in batches:
            out = []
            for text, lengths, begin, stop in zip(*(batch.column(c).to_pylist() for c in ("text", "lengths", "begin", "stop"))):
                if lengths is None:
                    out.append(encode(findall(text)))
                    continue
                at = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, narrow), dtype=np.int64)))
                at = at[(at >= begin) & (at <= (len(text) if stop is None else stop))].tolist()
                out.append(encode([text[a:b] for a, b in zip(at, at[1:])]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("n"), batch.column("k"), batch.column("row"), pa.array(out, pa.binary())], ["n", "k", "row", "ids"]
            )

    parted = pieces(cut, chunk)
    coded = parted.mapInArrow(work, parted.select("n", "k", "row", F.lit(b"").alias("ids")).schema)
    lists = coded.groupBy("n").agg(
        F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.struct("k", "ids"))).getField("ids").alias("parts")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = shared.value.kind
        for batch in batches:
            ids = [_wide(b"".join(parts), kind) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary())], ["row", "ids"])

    narrow = lists.select("row", "parts")
    return narrow.mapInArrow(joined, narrow.select("row", F.lit(b"").alias("ids")).schema)


def encoded(docs: DataFrame, words: Vocabulary, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, ids): every other column in ``row``, and the text's ids as little-endian unsigned 32-bit integers.

    Texts are cut into overlapping chunks that are matched against the pattern wherever they lie; neighbours are
    stitched at the first boundary that both have, and the pieces between are encoded, each match separately.
    A text of up to ``chunk`` bytes is one chunk and stays where it is, so only long texts are shuffled.

    NULL and empty texts have no ids. Bytes that are not UTF-8 count as the replacement character. Special tokens
    are ordinary text. Rows are encoded one by one, so repeated rows and ids, NULL or not, all come back. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return _short(rows.filter(size <= chunk), shared).union(_long(rows.filter(size > chunk), shared, chunk, overlap))


def decoded(rows: DataFrame, words: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes of their ids one after another, which need not be UTF-8
    where ids were cut. NULL stays NULL; an id that the vocabulary lacks is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    shape = rows.select("*", F.lit(b"").alias("decoded")).schema
    shape["decoded"].nullable = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in batches:
            out = [
                None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                for ids in batch.column(ids_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(work, shape)
