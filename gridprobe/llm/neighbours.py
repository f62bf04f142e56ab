"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridprobe.functions.binding import let
from gridprobe.llm.common import hash_share, release, stage
from gridprobe.llm.components import connected_components

THRESHOLD = 0.95
# Neighbours per vector, orders by random signatures that the first graph comes from, and places looked ahead.
NEIGHBOURS = 10
ORDERS = 6
AHEAD = 3
# Descent ends when a round changes less than this part of the lists.
STILL = 0.01
ROUNDS = 8
# Vectors the recall is audited on: in saturated components; outside these with links; without links, but with a
# neighbour not far below the threshold; and the rest. What the recall must reach before the search is over.
AUDITED = {"dense": 256, "linked": 1_024, "close": 512, "far": 512}
CLOSE = 0.1
RECALL = 0.98
# Vectors of about equally many links judge a search by themselves if at least so many were drawn.
AUDITED_GROUP = 16
WIDENINGS = 4
# Rows of a block when members of a component are compared, and tasks that a group is looked up in.
BLOCK = 1_024
SPREAD = 16


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of all linkable rows and (rep, vec, copies) of distinct vectors, scaled to length one.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components are left out. Equal vectors
    are one from here on: a group of copies of any size is a count.
    """
    as_double = F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), as_double.alias("raw"))
    largest = F.array_max(F.transform("raw", F.abs))
    usable = (
        F.col("raw").isNotNull() & ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (largest > 0) & F.col("id").isNotNull()
    )
    # Divided by the largest component first, so that no square overflows or vanishes.
    usable_rows = rows.filter(usable).withColumn("raw", let(largest, lambda top: F.transform("raw", lambda x: x / top)))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    scaled = usable_rows.select("id", let(norm, lambda size: F.transform("raw", lambda x: x / size)).alias("vec"))
    marked = stage(scaled, "unit")
    distinct = stage(marked.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    members = stage(marked.join(distinct, "vec").select("id", "rep"), "members")
    release(marked)
    return members, distinct.select("rep", "vec", "copies")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Both directions of undirected pairs."""
    return pa.record_batch({
        "src": pa.array(np.concatenate((a, b))), "dst": pa.array(np.concatenate((b, a))), "sim": pa.array(np.concatenate((sim, sim))),
    })


def first_graph(vectors: DataFrame, n: int, width: int, orders: int, seed: int) -> DataFrame:
    """Candidate edges (src, dst, sim): in each of several orders, vectors with those right behind them.

    An order sorts by the sides of random hyperplanes a vector lies on, then by a random projection. It is
    cut into ranges of equal size, so alike vectors, however many, do not gather in one task.
    """
    bits = min(max(int(math.log2(max(n, 2))) - 1, 4), 30)
    planes = np.random.default_rng(seed).normal(size=(orders, bits + 1, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for order in range(orders):
                side = x @ planes[order].T
                code = ((side[:, :bits] > 0) << np.arange(bits, dtype=np.int64)).sum(axis=1)
                yield pa.record_batch({
                    "ord": pa.array(np.full(len(x), order, np.int32)), "code": pa.array(code), "along": pa.array(side[:, bits]),
                    "rep": batch.column("rep"), "vec": batch.column("vec"),
                })

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None
        for batch in batches:
            now = batch.column("ord").to_numpy(), batch.column("rep").to_numpy(), _matrix(batch.column("vec"))
            if not len(now[0]):
                continue
            order, rep, x = now if tail is None else tuple(np.concatenate(p) for p in zip(tail, now))
            for step in range(1, min(AHEAD, len(x) - 1) + 1):
                same = order[step:] == order[:-step]
                sim = np.einsum("ij,ij->i", x[step:], x[:-step])
                yield _edges(rep[:-step][same], rep[step:][same], sim[same])
            tail = order[-AHEAD:], rep[-AHEAD:], x[-AHEAD:]

    signed = vectors.select("rep", "vec").mapInArrow(sign, "ord int, code long, along double, rep long, vec array<double>")
    placed = stage(signed, "signed")
    ranges = max(8, placed.rdd.getNumPartitions(), n * orders // 200_000)
    sorted_ = placed.repartitionByRange(ranges, "ord", "code", "along").sortWithinPartitions("ord", "code", "along")
    return sorted_.mapInArrow(link, "src long, dst long, sim double").distinct()


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar neighbours of every vector; ties go to the least id."""
    order = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return (
        edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
        .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")
    )


def local_joins(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """New edges between the neighbours of every vector, where they beat the worst entry of one of the two lists.

    A vector's list is its ``k`` best among those it points to and those that point to it, so no list, and no
    group of this join, has more than ``k`` members. ``graph`` marks edges that are ``fresh`` since the round
    before; a pair of which neither is fresh was compared then, and lists without a fresh edge stay where they are.
    """
    worst = graph.groupBy("src").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("held")).select(
        F.col("src").alias("rep"), F.when(F.col("held") < k, -2.0).otherwise(F.col("low")).alias("low")
    )
    known = vectors.join(worst, "rep", "left").select("rep", "vec", F.coalesce("low", F.lit(-2.0)).alias("low"))
    both = graph.union(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "fresh"))
    order = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    listed = (
        both.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
        .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
        .withColumn("any", F.max("fresh").over(Window.partitionBy("src"))).filter("any")
    )
    itself = listed.filter("at = 1").select("src", F.col("src").alias("dst"), F.lit(False).alias("fresh"))
    lists = listed.select("src", "dst", "fresh").union(itself)
    told = lists.join(known, lists["dst"] == known["rep"]).select(F.col("src").alias("hub"), "rep", "low", "fresh", "vec")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None
        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "rep", "low", "fresh")) + (_matrix(batch.column("vec")),)
            if not len(now[0]):
                continue
            hub, rep, low, fresh, x = now if tail is None else tuple(np.concatenate(p) for p in zip(tail, now))
            ends = np.flatnonzero(hub[1:] != hub[:-1]) + 1
            whole = int(ends[-1]) if len(ends) else 0
            yield from pairs(rep[:whole], low[:whole], fresh[:whole], x[:whole], [0, *ends.tolist()])
            tail = hub[whole:], rep[whole:], low[whole:], fresh[whole:], x[whole:]
        if tail is not None:
            yield from pairs(*tail[1:], [0, len(tail[0])])

    def pairs(rep, low, fresh, x, ends) -> Iterator[pa.RecordBatch]:
        found = []
        for a, b in zip(ends, ends[1:]):
            sim = x[a:b] @ x[a:b].T
            better = ((sim > low[a:b, None]) | (sim > low[None, a:b])) & (fresh[a:b, None] | fresh[None, a:b])
            i, j = np.nonzero(np.triu(better, 1))
            found.append((rep[a + i], rep[a + j], sim[i, j]))
        if found:
            yield _edges(*(np.concatenate(p) for p in zip(*found)))

    return told.repartition("hub").sortWithinPartitions("hub").mapInArrow(link, "src long, dst long, sim double").filter("src <> dst")


def descended(vectors: DataFrame, n: int, width: int, k: int, orders: int, seed: int, known: DataFrame | None) -> DataFrame:
    """A graph of ``k`` neighbours per vector, refined until it is nearly still."""
    start = first_graph(vectors, n, width, orders, seed)
    first = nearest(start if known is None else start.union(known.select("src", "dst", "sim")), k)
    graph = stage(first.withColumn("fresh", F.lit(True)), "graph")
    for _ in range(ROUNDS):
        found = local_joins(graph, vectors, k)
        following = nearest(graph.select("src", "dst", "sim").union(found), k)
        before = graph.select("src", "dst", F.lit(False).alias("seen"))
        following = stage(following.join(before, ["src", "dst"], "left").select("src", "dst", "sim", F.col("seen").isNull().alias("fresh")), "graph")
        changed, size = following.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
        release(graph)
        graph = following
        if changed <= STILL * size:
            break
    return graph


def _spread() -> Column:
    return F.pmod(F.xxhash64(F.lit("spread"), "rep"), F.lit(SPREAD)).cast("int")


def _replicated(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables once per block pair (one, two) of their group; ``ours`` tells the left ones."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ones")).join(
        right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("twos")), keys
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    columns = [*keys, "one", "two", "ours", "rep", "part", "sparse", "copies", "vec"]
    # Sizes are a row per group, so they go to several tasks each instead of all vectors of a group to one.
    sizes = sizes.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    left, right, keyed = left.withColumn("spread", _spread()), right.withColumn("spread", _spread()), [*keys, "spread"]
    ours = left.join(sizes, keyed).withColumn("one", place("ones")).withColumn("two", upto("twos")).withColumn("ours", F.lit(True))
    theirs = right.join(sizes, keyed).withColumn("two", place("twos")).withColumn("one", upto("ones")).withColumn("ours", F.lit(False))
    return ours.select(*columns).union(theirs.select(*columns))


def _compared(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(rep, links, u, v): links per vector, and pairs (u, v) of parts that a link joins, from the rows of ``_replicated``.

    A block pair returns counts and one row per pair of a part with the least part it is joined to, never
    its pairs, so a dense group of m vectors costs m rows per block.
    """

    def compare(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vec").combine_chunks())
        rep, part, copies = (table.column(c).to_numpy() for c in ("rep", "part", "copies"))
        ours = table.column("ours").to_numpy(zero_copy_only=False)
        sparse = table.column("sparse").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(ours), np.flatnonzero(~ours)
        linked = (x[a] @ x[b].T >= threshold) & (rep[a][:, None] != rep[b])
        # Vectors of sparse parts ask nothing themselves, and are told here.
        told = np.flatnonzero(sparse[b] & linked.any(axis=0))
        i, j = np.nonzero(linked)
        joins = np.unique(np.column_stack((part[a][i], part[b][j])), axis=0)
        joins = joins[joins[:, 0] != joins[:, 1]]
        none, blank = np.zeros(len(joins), np.int64), len(a) + len(told)
        return pa.table({
            "rep": pa.array(np.concatenate((rep[a], rep[b][told], joins[:, 0]))),
            "links": pa.array(np.concatenate((linked @ copies[b], copies[a] @ linked[:, told], none))),
            "u": pa.array([*[None] * blank, *joins[:, 0].tolist()], pa.int64()),
            "v": pa.array([*[None] * blank, *joins[:, 1].tolist()], pa.int64()),
        })

    return stage(rows.groupBy(*keys, "one", "two").applyInArrow(compare, "rep long, links long, u long, v long"), "compared")


def _near_parts(balls: DataFrame, threshold: float) -> DataFrame:
    """(ask, part): for every dense part all parts that may hold a link to it, itself among them.

    ``balls`` has (part, dense, radius, vec): all members of a part lie within the angle ``radius`` of ``vec``.
    """
    reach = math.acos(threshold) + 1e-6
    blocks = max(1, -(-balls.count() // BLOCK))
    block = F.pmod(F.xxhash64("part"), F.lit(blocks))
    upto = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    ours = balls.filter("dense").withColumn("one", block).withColumn("two", upto).withColumn("ours", F.lit(True))
    theirs = balls.withColumn("two", block).withColumn("one", upto).withColumn("ours", F.lit(False))

    def pair(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vec").combine_chunks())
        part, radius = table.column("part").to_numpy(), table.column("radius").to_numpy()
        ours = table.column("ours").to_numpy(zero_copy_only=False)
        angle = np.arccos(np.clip(x[ours] @ x[~ours].T, -1, 1))
        i, j = np.nonzero(angle <= radius[ours][:, None] + radius[~ours] + reach)
        return pa.table({"ask": pa.array(part[ours][i]), "part": pa.array(part[~ours][j])})

    columns = ["one", "two", "ours", "part", "radius", "vec"]
    both = ours.select(*columns).union(theirs.select(*columns))
    return both.groupBy("one", "two").applyInArrow(pair, "ask long, part long")


def _whole_lists(graph: DataFrame, vectors: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rep, links, dense) of every linked vector, and (node, component) of them.

    A vector whose list ends below the threshold has every link in it that the search has seen. One whose
    whole list is within the threshold is saturated: it may have more. All members of its component are
    compared, block by block, with the members of all components whose balls are near enough to hold a link,
    and components that a link joins become one.
    """
    near = stage(graph.filter(F.col("sim") >= threshold).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "near")
    parts = stage(connected_components(near), "parts")
    both = near.select("u", "v").union(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(vectors.select(F.col("rep").alias("v"), "copies"), "v").groupBy("u").agg(
        F.sum("copies").alias("links"), F.count(F.lit(1)).alias("held")
    )
    full = degree.filter(F.col("held") >= k).select(F.col("u").alias("node")).join(parts, "node").select("component").distinct()
    full = full.withColumn("full", F.lit(True))
    member = stage(
        parts.join(full, "component", "left").join(vectors, F.col("node") == F.col("rep"))
        .select(F.col("component").alias("part"), F.col("full").isNull().alias("sparse"), "rep", "copies", "vec"), "linked",
    )
    centre = member.filter("rep = part").select("part", F.col("vec").alias("centre"))
    cosine = F.aggregate(F.zip_with("vec", "centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    radius = member.join(centre, "part").groupBy("part").agg(
        F.max(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))).alias("radius"), F.first("sparse").alias("sparse")
    )
    balls = radius.join(centre, "part").select("part", (~F.col("sparse")).alias("dense"), "radius", F.col("centre").alias("vec"))
    asked = stage(_near_parts(stage(balls, "balls"), threshold), "asked")
    left = member.filter("NOT sparse").withColumn("ask", F.col("part"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    wanted = asked.withColumn("spread", spread).join(member.withColumn("spread", _spread()), ["part", "spread"]).drop("spread")
    found = _compared(_replicated(left, wanted, ["ask"]), ["ask"], threshold)
    kept = degree.join(parts, F.col("u") == F.col("node")).join(full, "component", "left_anti").select(F.col("u").alias("rep"), "links")
    dense = member.select("rep", (~F.col("sparse")).alias("dense"))
    links = found.filter("u IS NULL").select("rep", "links").union(kept).groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.filter("u IS NOT NULL").select("u", "v")).select(
        F.col("node").alias("component"), F.col("component").alias("whole")
    )
    named = parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return stage(links.join(dense, "rep"), "degrees"), stage(named, "parts")


def _all_pairs(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The same by comparing every block of vectors with every other: exact, and quadratic in the vectors."""
    every = vectors.select(F.lit(0).alias("ask"), "rep", F.col("rep").alias("part"), F.lit(False).alias("sparse"), "copies", "vec")
    found = _compared(_replicated(every, every, ["ask"]), ["ask"], threshold)
    links = found.filter("u IS NULL").groupBy("rep").agg(F.sum("links").alias("links")).filter("links > 0")
    parts = connected_components(found.filter("u IS NOT NULL").select("u", "v"))
    return stage(links.withColumn("dense", F.lit(True)), "degrees"), stage(parts, "parts")


def _audit(vectors: DataFrame, degrees: DataFrame, graph: DataFrame, threshold: float) -> float:
    """The part of links found per linked vector, on samples compared with all rows in blocks: the least of
    ``least_recall`` inside and outside saturated components.

    Those with links, those without but with a close neighbour, and the rest are drawn apart (``AUDITED``), each
    counting for as many as it was drawn from; so linked vectors are in the audit however rare they are, all of them
    if they are few, and vectors whose links were all missed count as what they stand for. 1.0 says that none of the
    vectors drawn has a link.
    """
    close = graph.filter(F.col("sim") < threshold).groupBy(F.col("src").alias("rep")).agg(F.max("sim").alias("close"))
    kind = (
        F.when(F.col("dense"), "dense").when(F.col("links") > 0, "linked")
        .when(F.col("close") >= threshold - CLOSE, "close").otherwise("far").alias("kind")
    )
    known = stage(
        vectors.select("rep").join(degrees, "rep", "left").join(close, "rep", "left")
        .select("rep", F.coalesce("links", F.lit(0)).alias("links"), kind, F.xxhash64(F.lit("audit"), "rep").alias("mark")), "kinds",
    )
    sizes = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    drawn = [
        known.filter((F.col("kind") == name) & (hash_share(F.col("rep")) < 2 * AUDITED[name] / size)).orderBy("mark").limit(AUDITED[name])
        for name, size in sorted(sizes.items())
    ]
    # As many rows as AUDITED says, whatever the table.
    asked = vectors.join(F.broadcast(reduce(DataFrame.union, drawn)), "rep").select("rep", "vec", "links", "kind").collect()
    release(known)
    ids, x = np.array([r["rep"] for r in asked]), np.array([r["vec"] for r in asked])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column("vec")) @ x.T >= threshold) & (batch.column("rep").to_numpy()[:, None] != ids)
                total += (batch.column("copies").to_numpy() @ near).astype(np.int64)
        yield pa.record_batch({"rep": pa.array(ids), "links": pa.array(total)})

    true = {r["rep"]: r["true"] for r in vectors.mapInArrow(compare, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("true")).collect()}
    times = {name: size / max(sum(r["kind"] == name for r in asked), 1) for name, size in sizes.items()}
    told = [(r["kind"] == "dense", r["links"], true[r["rep"]], times[r["kind"]]) for r in asked]
    return min(least_recall([t[1:] for t in told if t[0] == dense]) for dense in (True, False))


def least_recall(links: list[tuple]) -> float:
    """Of (found, true, vectors it stands for, 1 if left out) per vector: the least mean of found / true, over all and
    by the power of two of true, if ``AUDITED_GROUP`` vectors or more have it."""
    groups: dict[int, list[tuple[float, float]]] = {}
    for found, true, *times in links:
        if true:
            for group in (0, int(true).bit_length()):
                groups.setdefault(group, []).append((min(found, true) / true, times[0] if times else 1.0))
    means = [sum(r * t for r, t in g) / sum(t for _, t in g) for name, g in groups.items() if name == 0 or len(g) >= AUDITED_GROUP]
    return min(means, default=1.0)


def _searched(distinct: DataFrame, width: int, threshold: float, k: int) -> DataFrame:
    """(rep, links, component_id) of distinct vectors of one length, of which there is at least one."""
    n, graph = distinct.count(), None
    for widening in range(WIDENINGS + 1):
        k_now = k << widening
        graph = descended(distinct, n, width, k_now, ORDERS << widening, widening, graph)
        degrees, parts = _whole_lists(graph, distinct, k_now, threshold)
        if _audit(distinct, degrees, graph, threshold) >= RECALL:
            break
    else:
        degrees, parts = _all_pairs(distinct, threshold)
    own = distinct.select("rep", "copies")
    return own.join(degrees, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component_id")
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): which vectors have a cosine of ``threshold`` or more.

    NN-descent over distinct vectors: neighbours of neighbours are compared and every vector keeps its ``k``
    best until the lists are still; saturated lists are enlarged (see ``_whole_lists``); then the recall of links
    per linked vector is audited on samples, in which linked vectors are whatever their share, against all rows, and
    as long as it is below ``RECALL`` the search goes on with more orders and longer lists. Where the last widening falls short, all pairs are compared. Only pairs whose cosine, in double precision, reaches the threshold count.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing. Equal vectors
    link with each other. Rows with equal ids are separate vectors, each in the component of its own vector. A NULL id links
    with nothing. An empty table gives an empty result. Other columns are ignored. Vectors of different lengths have no
    cosine and do not link: each length is searched by itself, one after the other.
    """
    members, distinct = unit_vectors(vectors, id_col, vector_col)
    lengths = [r["width"] for r in distinct.select(F.size("vec").alias("width")).distinct().orderBy("width").collect()]
    searched = [_searched(distinct if len(lengths) == 1 else stage(distinct.filter(F.size("vec") == width), "vectors"), width, threshold, k) for width in lengths]
    if searched:
        named = reduce(DataFrame.union, searched)
    else:
        named = distinct.select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component_id"))
    linked = members.join(named, "rep").select("id", F.col("links").alias("n_links"), "component_id")
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    lone = ids.join(linked.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(lone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
