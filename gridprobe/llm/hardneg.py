"""Hard negatives by threshold joins over an inverted index whose lists are cut by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.llm.common import release, stage

# Rows of an index block, anchors that are compared with a block at once, and dimensions of one posting list.
BLOCK = 4_096
GROUP = 512
STRIP = 8
# Components in the blocks that a task keeps at once, and groups that it compares with them.
HELD = 1 << 22
LOT = 64
# Such comparisons per core at least, where there are as many pairs.
TILES = 4
# Rows of a block that go through its lists together.
ROWS = 128
# Thresholds of the searches, from round to round: parts of the anchor's squared norm for positives, of the
# positive's score for negatives. Whatever is not full after the last of them takes every row that may count.
POSITIVE_LEVELS = (0.8, 0.6, 0.45, 0.3, 0.15, None)
NEGATIVE_LEVELS = (0.85, 0.7, None)
# Sums of products are exact in double precision below this.
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Neither NULL nor with a NULL or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """[row, strip]: the norm of a row's components from the strip on; 0 behind the last."""
    cuts = range(0, x.shape[1], STRIP)
    squares = np.stack([(x[:, a : a + STRIP] ** 2).sum(axis=1) for a in cuts] + [np.zeros(len(x))], axis=1)
    return np.sqrt(squares[:, ::-1].cumsum(axis=1)[:, ::-1])


INDEX = "dim int, salt long, ids binary, labels binary, dims binary, vectors binary, norms binary, lists binary"


def index(points: DataFrame, salts: int) -> DataFrame:
    """Blocks of about ``BLOCK`` rows with an inverted index each.

    Dimensions come in the order of their energy in the block, in strips. The posting list of a strip has the
    rows in falling order of their suffix norm from that strip on. So for any threshold the rows that a list
    must name are a prefix of it: where the suffix norm times the anchor's norm stays below the threshold, the
    rest of the row alone cannot reach it and is left out. A lower threshold takes a longer prefix of the same lists.
    """

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        x = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order = np.lexsort((ids, labels))
        dims = np.argsort(-(x**2).sum(axis=0), kind="stable").astype(np.int32)
        ids, labels, x = ids[order], labels[order], np.ascontiguousarray(x[order][:, dims])
        norms = _suffix_norms(x)
        lists = np.argsort(-norms[:, :-1], axis=0, kind="stable").T.astype(np.int32)
        blobs = [ids, labels, dims, x, norms, lists]
        return pa.table([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int64())]
                        + [pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs],
                        names=["dim", "salt", "ids", "labels", "dims", "vectors", "norms", "lists"])

    placed = points.select("dim", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), "id", "label", "vec")
    return stage(placed.groupBy("dim", "salt").applyInArrow(build, INDEX), "index")


class _Block:
    """An index block as arrays."""

    def __init__(self, row: dict):
        dim = row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.dims, m = np.frombuffer(row["dims"], np.int32), len(self.ids)
        self.x = np.frombuffer(row["vectors"]).reshape(m, dim)
        self.norms = np.frombuffer(row["norms"]).reshape(m, -1)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(-1, m)

    def reaching(self, q: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs of the given rows whose score is at least the anchor's ``least``.

        Scores grow strip by strip along the lists. A pair goes as soon as what it has and the product of both
        remaining norms stay below the threshold; the rest of those that are left is added exactly.
        """
        own = _suffix_norms(q)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)) + own[:, 0] * self.norms[:, 0].max(initial=0))
        bar = least - slack
        with np.errstate(divide="ignore", invalid="ignore"):
            per_norm = np.where(own[:, 0] > 0, bar / own[:, 0], np.where(bar <= 0, -np.inf, np.inf))
        floor = per_norm.min(initial=np.inf)
        # A row whose whole norm is below the floor is in no list.
        rows = rows[self.norms[rows, 0] >= floor]
        named = [listed[: np.searchsorted(-self.norms[listed, s], -floor, side="right")] for s, listed in enumerate(self.lists)]
        # Rows go through the lists in lots whose scores stay in a core's cache, and scores lie row by row.
        own, turned = np.ascontiguousarray(own.T), np.ascontiguousarray(q.T)
        found = [self._lot(q, turned, own, least, bar, named, rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)]
        if not found:
            return np.zeros(0, np.int64), rows, np.zeros(0)
        return tuple(map(np.concatenate, zip(*found)))

    def _lot(self, q: np.ndarray, turned: np.ndarray, own: np.ndarray, least: np.ndarray, bar: np.ndarray, lists: list,
             rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``reaching`` gives for some rows; ``turned`` and ``own`` have a column per anchor."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        score, done = np.zeros((len(rows), len(q))), np.zeros(len(rows), np.int64)
        open_pairs = np.ones(score.shape, bool)
        for s, named in enumerate(lists):
            if not len(rows):
                break
            at = place[named]
            at = at[at >= 0]
            if not len(at):
                break
            part = slice(s * STRIP, (s + 1) * STRIP)
            if len(at) == len(rows):
                score += self.x[rows, part] @ turned[part]
                done[:] = s + 1
                bound = np.multiply.outer(self.norms[rows, s + 1], own[s + 1])
            else:
                score[at] += self.x[rows[at], part] @ turned[part]
                done[at] = s + 1
                bound = own[done]
                bound *= self.norms[rows, done][:, None]
            bound += score
            open_pairs = bound >= bar
            alive = open_pairs.any(axis=1)
            if not alive.all():
                place[rows] = -1
                rows, score, done, open_pairs = rows[alive], score[alive], done[alive], open_pairs[alive]
                place[rows] = np.arange(len(rows))
        r, a = np.nonzero(open_pairs)
        total = score[r, a]
        for s in np.unique(done[r]).tolist():
            rest = np.flatnonzero(done[r] == s) if s < len(self.lists) else ()
            for lot in (rest[i : i + 65_536] for i in range(0, len(rest), 65_536)):
                total[lot] += np.einsum("ij,ij->i", q[a[lot], s * STRIP :], self.x[rows[r[lot]], s * STRIP :])
        enough = total >= least[a]
        return a[enough], rows[r[enough]], total[enough]


def _best(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each anchor: by score, then by the smaller id."""
    order = np.lexsort((ids, -score, a))
    sorted_a = a[order]
    first = np.searchsorted(sorted_a, sorted_a, side="left")
    return order[np.arange(len(order)) - first < k]


def _positives(block: _Block, group: dict, level: float | None, k: int) -> Iterator[tuple]:
    """(row, 0, id, score) of the best rows with the anchor's label, another id and a score above the level."""
    for label in np.intersect1d(group["labels"], block.labels).tolist():
        mine = np.flatnonzero(group["labels"] == label)
        q = group["vectors"][mine][:, block.dims]
        least = np.full(len(mine), -np.inf) if level is None else level * (q**2).sum(axis=1)
        a, r, score = block.reaching(q, least, np.arange(*np.searchsorted(block.labels, [label, label + 1])))
        other = block.ids[r] != group["ids"][mine][a]
        a, r, score = a[other], r[other], score[other]
        best = _best(a, block.ids[r], score, k)
        yield group["rows"][mine][a[best]], np.zeros(len(best), np.int32), block.ids[r[best]], score[best]


def _negatives(block: _Block, group: dict, level: float | None, k: int, low: int, high: int) -> Iterator[tuple]:
    """(row, place, id, score) of the best rows with another label inside the window of each open positive."""
    windows = group["windows"]
    q = group["vectors"][:, block.dims]
    with np.errstate(invalid="ignore"):
        lowest = np.ceil(low * windows / 100) if level is None else np.maximum(np.ceil(level * windows), np.ceil(low * windows / 100))
    least = np.nanmin(lowest, axis=1)
    a, r, score = block.reaching(q, least, np.arange(len(block.ids)))
    other = block.labels[r] != group["labels"][a]
    a, r, score = a[other], r[other], score[other]
    for place in range(windows.shape[1]):
        wanted = windows[a, place]
        with np.errstate(invalid="ignore"):
            # A closed window is NaN, which nothing compares with.
            inside = np.flatnonzero((100 * score <= high * wanted) & (100 * score >= low * wanted) & (score >= lowest[a, place]))
        best = inside[_best(a[inside], block.ids[r[inside]], score[inside], k)]
        yield group["rows"][a[best]], np.full(len(best), place, np.int32), block.ids[r[best]], score[best]


def _searched(asks: DataFrame, blocks: DataFrame, salts: int, held: int, waiting: int, k: int, find) -> DataFrame:
    """(row, place, rank, id, score): the ``k`` best that ``find`` gives for the anchors in ``asks``, over all blocks.

    Pairs of a group of anchors and a block are dealt out as tiles: at most ``held`` blocks by at most ``LOT`` groups,
    and less where that leaves cores without a tile. A task keeps the blocks of its tile, lets the groups pass one by
    one, and returns at most ``k`` rows per anchor and place. Groups are copied per tile, so this is no join: a planner
    takes their size from before the copying, and would send every copy through the driver.
    """

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width = len(table.column("windows")[0])
        blobs = [table.column("row").to_numpy(), table.column("id").to_numpy(), table.column("label").to_numpy(),
                 table.column("vec").combine_chunks().flatten().to_numpy(),
                 np.array(table.column("windows").to_pylist(), np.float64)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([width], pa.int32())]
                        + [pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs],
                        names=["dim", "group", "width", "g_rows", "g_ids", "g_labels", "g_vectors", "g_windows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, own = None, []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if dim != row["dim"]:
                    dim, own = row["dim"], []
                if row["width"] is None:
                    own.append(_Block(row))
                    continue
                group = {c: np.frombuffer(row[f"g_{c}"], np.int64) for c in ("rows", "ids", "labels")}
                n = len(group["rows"])
                group["vectors"] = np.frombuffer(row["g_vectors"]).reshape(n, dim)
                group["windows"] = np.frombuffer(row["g_windows"]).reshape(n, row["width"])
                parts = [part for block in own for part in find(block, group)]
                if parts:
                    rows, place, ids, score = map(np.concatenate, zip(*parts))
                    best = _best(np.unique(rows, return_inverse=True)[1] * row["width"] + place, ids, score, k)
                    yield pa.record_batch({"row": pa.array(rows[best]), "place": pa.array(place[best]), "id": pa.array(ids[best]),
                                           "score": pa.array(score[best].astype(np.int64))})

    groups = -(-waiting // GROUP)
    packed = asks.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("dim", "group").applyInArrow(
        pack, "dim int, group long, width int, g_rows binary, g_ids binary, g_labels binary, g_vectors binary, g_windows binary"
    )
    wanted = TILES * asks.sparkSession.sparkContext.defaultParallelism
    shares = max(-(-salts // held), min(salts, wanted))
    lots = max(-(-groups // LOT), min(groups, -(-wanted // shares)))
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    share, lot = F.pmod(F.col("salt"), F.lit(shares)), F.pmod(F.col("group"), F.lit(lots))
    tiles = blocks.withColumn("tile", F.explode(F.transform(each(lots), lambda i: (share * lots + i).cast("int")))).unionByName(
        packed.withColumn("tile", F.explode(F.transform(each(shares), lambda i: (i * lots + lot).cast("int")))), allowMissingColumns=True
    )
    # A block has no width, and comes before the groups of its dimension.
    dealt = tiles.repartitionById(shares * lots, "tile").sortWithinPartitions("dim", F.col("width").asc_nulls_first())
    found = dealt.mapInArrow(work, "row long, place int, id long, score long")
    by_score = Window.partitionBy("row", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("row", "place", "rank", "id", "score")


def _filled(asks: DataFrame, blocks: DataFrame, salts: int, held: int, k: int, levels: tuple, find) -> DataFrame:
    """(row, place, rank, id, score) of all anchors: the threshold falls from level to level, and only places
    that have fewer than ``k`` rows are asked again. A row above a threshold beats all below it, so a place that
    is full is final."""
    out = None
    for level in levels:
        waiting = asks.count()
        if not waiting:
            break
        found = stage(_searched(asks, blocks, salts, held, waiting, k, lambda b, g, level=level: find(b, g, level)), "found")
        full = found.groupBy("row", "place").agg(F.count(F.lit(1)).alias("n"))
        full = full if level is None else full.filter(F.col("n") >= k)
        final = found.join(full.select("row", "place"), ["row", "place"], "left_semi")
        out = final if out is None else out.union(final)
        if level is None:
            break
        closed = full.groupBy("row").agg(F.collect_set("place").alias("closed"))
        open_windows = F.transform(
            "windows", lambda x, i: F.when(F.array_contains(F.coalesce("closed", F.array().cast("array<int>")), i), None).otherwise(x)
        )
        left = asks.join(closed, "row", "left").withColumn("windows", open_windows).drop("closed")
        following = stage(left.filter(F.exists("windows", lambda x: x.isNotNull())), "asks")
        release(asks)
        asks = following
    return out


def mined(points: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vec",
          positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows have an integral id and label and a vector of whole numbers; scores are inner products, higher first,
    ties by the smaller id. Rows for which ``anchor`` holds are anchors. An anchor's positives are the first
    other rows of its label. For each of them, the negatives are the first rows of other labels whose score
    is from ``low`` to ``high`` percent of the positive's.

    Rows without id, label or usable vector take no part. Only vectors of one length are compared. Rows that repeat
    an id are rows of their own, as anchors too, but are no other rows for their id. Vectors so long that sums of
    products are not exact in double precision are an error. Other columns are ignored; an empty table, or one
    without anchors, gives an empty result.
    """
    rows = points.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), F.size("vec").alias("dim"), "*"), "points")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, longest, widest = rows.agg(F.count(F.lit(1)), F.max(square), F.max("dim")).first()
    if (longest or 0.0) >= EXACT:
        raise ValueError(f"a squared norm is {longest:g}; scores are exact below {EXACT:g} only")
    salts = max(1, -(-n // BLOCK))
    held = max(1, HELD // (BLOCK * max(1, widest or 0)))
    blocks = index(rows, salts)
    # The score of the anchor itself stands for its one window while positives are looked for.
    anchors = stage(rows.filter("anchor").select("row", "id", "label", "dim", "vec", F.array(F.lit(0.0)).alias("windows")), "asks")
    empty = rows.sparkSession.createDataFrame([], "row long, place int, rank int, id long, score long")
    near = _filled(anchors, blocks, salts, held, positives, POSITIVE_LEVELS, lambda b, g, level: _positives(b, g, level, positives)) or empty
    near = stage(near.select("row", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # All anchors have as many places; those without a positive are closed from the start.
    at = F.map_from_entries(F.collect_list(F.struct("place", F.col("positive_score").cast("double"))))
    windows = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.element_at("at", i))
    known = near.groupBy("row").agg(at.alias("at")).select("row", windows.alias("windows"))
    asks = stage(rows.filter("anchor").select("row", "id", "label", "dim", "vec").join(known, "row"), "asks")
    hard = _filled(asks, blocks, salts, held, negatives, NEGATIVE_LEVELS, lambda b, g, level: _negatives(b, g, level, negatives, low, high)) or empty
    named = rows.filter("anchor").select("row", F.col("id").alias("anchor_id"))
    return (
        hard.select("row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near, ["row", "place"]).join(named, "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
