"""SimHash fingerprints, and near-duplicates by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.llm.common import release, stage, texts
from gridprobe.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
# A trie is cut at the depth where a node has about so many fingerprints.
NODE_ROWS = 2048
# Node pairs that are split at once; more wait on a stack.
FRONTIER = 1 << 18


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of ``width`` words, joined by single spaces; a shorter text is one run, an empty one has none."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    return [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    runs = shingles(text or b"", width)
    hashed = xxhash.xxh64_intdigest
    return majority(np.fromiter((hashed(run, SEED) for run in runs), np.uint64, len(runs)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text, as a signed long. NULL texts count as empty: zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch({"id": batch.column("id"), "fp": pa.array(values)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, fp long")


# --- the trie ---------------------------------------------------------------------------------


def _ones_before(values: np.ndarray) -> list[np.ndarray]:
    """Per depth, how many of the sorted values before each place have that bit set."""
    shifts = np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return [np.concatenate(([0], np.cumsum((values >> s) & np.uint64(1), dtype=np.int64))) for s in shifts]


def _halves(ones: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the node that spans [low, high) splits into its 0 and its 1 child."""
    return high - (ones[high] - ones[low])


def linked_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, half_budget: int, budget: int,
                 differing: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted fingerprints that differ in at most ``budget`` bits and in at most
    ``half_budget`` of the first half. With ``right`` None the left side is joined with itself.

    All values of a side share their first ``depth`` bits, in which the sides differ by ``differing``. Node
    pairs descend together. A pair whose differing bits exceed the budget at its depth is dropped with
    everything below it. Two leaves are compared at once.
    """
    same = right is None
    right = left if same else right
    ones_left = _ones_before(left)
    ones_right = ones_left if same else _ones_before(right)
    stack = [(depth, np.array([[0, len(left), 0, len(right), differing]], np.int64))]
    while stack:
        at, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(at, part) for part in np.array_split(pairs, len(pairs) // FRONTIER + 1)]
            continue
        a0, a1, b0, b1, wrong = pairs.T
        # A node beside itself with one fingerprint holds no pair.
        itself = (a0 == b0) & (a1 == b1) if same else np.zeros(len(pairs), bool)
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if at == BITS:
            leaf[:] = True
        found = leaf & ~itself
        if found.any():
            u, v = a0[found], b0[found]
            far = np.bitwise_count(left[u] ^ right[v])
            near = np.bitwise_count((left[u] ^ right[v]) >> np.uint64(BITS // 2)) <= half_budget
            keep = near & (far <= budget)
            yield u[keep], v[keep]
        pairs, itself = pairs[~leaf], itself[~leaf]
        if not len(pairs):
            continue
        a0, a1, b0, b1, wrong = pairs.T
        am, bm = _halves(ones_left[at], a0, a1), _halves(ones_right[at], b0, b1)
        children = [
            np.stack((a0, am, b0, bm, wrong), 1), np.stack((am, a1, bm, b1, wrong), 1),
            np.stack((a0, am, bm, b1, wrong + 1), 1), np.stack((am, a1, b0, bm, wrong + 1), 1)[~itself],
        ]
        following = np.concatenate(children)
        allowed = half_budget if at < BITS // 2 else budget
        alive = (following[:, 1] > following[:, 0]) & (following[:, 3] > following[:, 2]) & (following[:, 4] <= allowed)
        stack.append((at + 1, following[alive]))


class _Forest:
    """Least members of linked groups, so that a task returns an edge per fingerprint at most."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.low[u], self.low[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.low, np.maximum(a, b), np.minimum(a, b))
            while (self.low[self.low] != self.low).any():
                self.low = self.low[self.low]


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return values if not by else (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def trie_links(distinct: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of the column ``fp``, given once each, within ``radius``.

    Fingerprints within the radius differ by at most half of it in one of their halves, so two tries are
    walked, one from each half, in which the error budget of the first 32 levels is only half. The tries
    are cut at the depth where nodes are small, and every pair of nodes within budget there is the work of
    one group: a node goes to the few nodes whose prefix differs in as many bits as allowed. A group of m
    fingerprints returns at most m - 1 edges that connect the same ones as its links do.
    """
    half = radius // 2
    n = distinct.count()
    depth = min(max(int(np.ceil(np.log2(max(n, 1) / node_rows))), 4), 24)
    masks = sorted(sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(depth), k))

    def walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shift = np.uint64(BITS - depth)
        values = np.sort(table.column("turned").to_numpy().view(np.uint64))
        prefixes = values >> shift
        first, last = int(key[1].as_py()), int(key[2].as_py())
        cut = int(np.searchsorted(prefixes, prefixes[0], side="right"))
        if first == last:
            sides = (values, None, 0)
        elif cut == len(values):
            sides = None  # the partner node is empty
        else:
            sides = (values[:cut], values[cut:], (first ^ last).bit_count())
        u = v = np.empty(0, np.int64)
        if sides:
            forest = _Forest(len(values))
            offset = 0 if sides[1] is None else cut
            for a, b in linked_pairs(sides[0], sides[1], depth, half, radius, sides[2]):
                forest.link(a, b + offset)
            v = np.flatnonzero(forest.low != np.arange(len(values)))
            u = forest.low[v]
        back = BITS - 32 if key[0].as_py() else 0
        turned = _rotated(values, back).view(np.int64)
        return pa.table({"u": turned[u], "v": turned[v]})

    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    sides = distinct.select(F.explode(F.array(
        F.struct(F.lit(0).alias("trie"), F.col("fp").alias("turned")), F.struct(F.lit(1).alias("trie"), turned.alias("turned"))
    )).alias("side")).select("side.*")
    node = F.shiftrightunsigned("turned", BITS - depth)
    partners = sides.withColumn("node", node).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    groups = partners.select(
        "trie", F.least("node", other).alias("first"), F.greatest("node", other).alias("last"), "turned"
    ).groupBy("trie", "first", "last")
    return groups.applyInArrow(walk, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id): texts whose fingerprints differ in at most ``radius`` bits are linked,
    and the component is the least id that links reach, its own included.

    Equal fingerprints are merged before anything else, so a group of copies of any size is one row in the
    trie. Words are cut at ASCII white space and lower-cased in A-Z. NULL and wordless texts have
    fingerprint zero and are linked like any other. One row per input row; rows with equal ids keep one row
    each. NULL ids never name a component unless no other id is in it. Other columns are ignored; an empty
    table gives an empty result.
    """
    marked = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    edges = stage(trie_links(distinct.select("fp"), radius), "links")
    nodes = connected_components(edges)
    release(edges)
    joined = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(joined.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, that stay when one of each component does: that with the least id.

    Of rows that repeat an id one stays. Rows without an id take part after all others, by a hash of their text.
    """
    spare = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text_col), F.lit(1 << 62))
    keyed = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), spare).alias("key"), F.col(text_col).alias("text")
    )
    lowest = near_duplicates(keyed, "key", "text", radius).filter("key = component_id").select("key").distinct()
    kept = keyed.join(lowest, "key", "left_semi")
    order = Window.partitionBy("key").orderBy(F.xxhash64("text"))
    return kept.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row.*")
