"""Label codes, scaling, splits, batches and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridprobe.catalog.registry import csv, hash_sql, query, reader, rounded
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import labels, ranks, scaling, splits
from gridprobe.operators.unnest import unnest
from gridprobe.plans import datasets as ds
from gridprobe.sources import sinks

from gridprobe.catalog.grids import customer_ids, order_ids, part_ids

SEED = 7


@query("W1 U2 J3", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS lang_encoded FROM documents""")
def encoded_languages(spark, sf):
    return labels.encode(reader(spark, sf)("documents").select("doc_id", "lang"), "lang")


@query("W1 U2", """
SELECT p_partkey, p_retailprice, CAST(dense_rank() OVER (ORDER BY p_retailprice) - 1 AS INT) AS code FROM part""")
def encoded_large_domain(spark, sf):
    """A domain beyond the small-domain limit: coded by range shuffle and joined without a broadcast."""
    parts = reader(spark, sf)("part").select("p_partkey", "p_retailprice")
    return labels.encode(parts, "p_retailprice", "code", limit=20)


@query("W3", """
WITH classes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id, array_to_string([CASE WHEN i = c THEN 1 ELSE 0 END for i in range(5)], ',') AS one_hot FROM events JOIN classes USING (event_type)""")
def one_hot_events(spark, sf):
    df = labels.one_hot(reader(spark, sf)("events").select("event_id", "event_type"), "event_type")
    return df.select("event_id", csv(F.col("event_type_ohe").cast("array<int>")).alias("one_hot"))


@query("U2", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf):
    return labels.domain(reader(spark, sf)("documents"), "source")


@query("A2", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, round(CAST(CAST((value - lo) / (hi - lo) AS FLOAT) AS DOUBLE), 6) + 0.0 AS scaled FROM events, r""")
def scaled_event_values(spark, sf):
    df = scaling.min_max(reader(spark, sf)("events").select("event_id", "value"), "value", "scaled")
    return df.select("event_id", rounded(F.col("scaled").cast("double")).alias("scaled"))


@query("A2", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, round(CAST(CAST((l_extendedprice - lo) / (hi - lo) AS FLOAT) AS DOUBLE), 6) + 0.0 AS scaled FROM lineitem, r""")
def scaled_prices(spark, sf):
    lines = reader(spark, sf)("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    df = scaling.min_max(lines, "l_extendedprice", "scaled")
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", rounded(F.col("scaled").cast("double")).alias("scaled"))


CELLS = "SELECT vec_id, label, CAST(i AS INT) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)"


@query("A3", f"""
SELECT dim, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS deviation FROM ({CELLS}) GROUP BY dim""")
def dimension_statistics(spark, sf):
    stats = scaling.dimension_stats(reader(spark, sf)("embeddings"), "embedding")
    cells = stats.select("n", F.posexplode(F.arrays_zip("means", "deviations")).alias("dim", "s"))
    return cells.select(
        "dim", "n", rounded(F.col("s.means")).alias("mean"), rounded(F.col("s.deviations")).alias("deviation")
    )


@query("A3", f"""
SELECT label, dim, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS deviation FROM ({CELLS}) GROUP BY label, dim""")
def dimension_statistics_by_label(spark, sf):
    stats = scaling.dimension_stats(reader(spark, sf)("embeddings"), "embedding", "label")
    cells = stats.select("label", "n", F.posexplode(F.arrays_zip("means", "deviations")).alias("dim", "s"))
    return cells.select(
        "label", "dim", "n", rounded(F.col("s.means")).alias("mean"), rounded(F.col("s.deviations")).alias("deviation")
    )


def split_sql(seed):
    """The embeddings with their split, as common table expressions."""
    return f"""keyed AS (SELECT *, {hash_sql(seed, 'vec_id')} AS h FROM embeddings),
placed AS (SELECT *, row_number() OVER (ORDER BY h, vec_id) - 1 AS pos, count(*) OVER () AS n FROM keyed),
sized AS (SELECT *, CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT) AS t FROM placed),
divided AS (SELECT *, CASE WHEN pos < t THEN 'train' WHEN pos < t + (n - t) // 2 THEN 'valid' ELSE 'test' END AS split FROM sized)"""


SPLIT = split_sql(SEED)


@query("A3 W5 M1", f"""
WITH {SPLIT}, cells AS (SELECT vec_id, split, CAST(i AS INT) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS x FROM divided, range(64) r(i)),
stats AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM cells WHERE split = 'train' GROUP BY dim)
SELECT vec_id, split, dim, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS z FROM cells JOIN stats USING (dim)""")
def standardised_vectors(spark, sf):
    """Fitted on the training split, applied to every row."""
    df = splits.shuffle_split(reader(spark, sf)("embeddings"), "vec_id", SEED)
    scaled = scaling.standardise(df, "embedding", "z", fit_on=df.filter("split = 'train'"))
    return unnest(scaled, "z", "vec_id", "split", index="dim", value="z").withColumn("z", rounded(F.col("z")))


@query("W5", f"WITH {SPLIT} SELECT vec_id, split FROM divided")
def shuffle_split_embeddings(spark, sf):
    return splits.shuffle_split(reader(spark, sf)("embeddings"), "vec_id", SEED).select("vec_id", "split")


ORDER_SPLIT = SPLIT.replace("vec_id", "o_orderkey").replace("FROM embeddings", "FROM orders")


@query("W5 A13", f"""
WITH {ORDER_SPLIT} SELECT split, o_orderpriority, count(*) AS n FROM divided GROUP BY ALL""")
def label_distribution_per_split(spark, sf):
    df = splits.shuffle_split(reader(spark, sf)("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", SEED)
    return labels.split_distribution(df, "o_orderpriority")


def _tails(table: str, label: str, key: str) -> str:
    return f"""placed AS (SELECT {key}, {label}, row_number() OVER (ORDER BY {label}, {key}) - 1 AS pos, count(*) OVER () AS n FROM {table}),
sided AS (SELECT *, pos >= CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AND pos < CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS mid, {hash_sql(SEED, key)} AS h FROM placed),
halved AS (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY h, {key}) - 1 AS hpos, count(*) OVER (PARTITION BY mid) AS m FROM sided),
divided AS (SELECT *, CASE WHEN mid THEN 'train' WHEN hpos < m // 2 THEN 'test' ELSE 'valid' END AS split FROM halved)"""


@query("W6 U1 O2", f"""
WITH {_tails('events', 'value', 'event_id')} SELECT event_id, value, split FROM divided""")
def extrapolation_split_events(spark, sf):
    events = reader(spark, sf)("events").select("event_id", "value")
    return splits.extrapolation_split(events, "value", "event_id", SEED)


@query("W6 A13", f"""
WITH {_tails('orders', 'o_totalprice', 'o_orderkey')}
SELECT split, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM divided GROUP BY split""")
def extrapolation_split_orders(spark, sf):
    orders = reader(spark, sf)("orders").select("o_orderkey", "o_totalprice")
    df = splits.extrapolation_split(orders, "o_totalprice", "o_orderkey", SEED)
    return df.groupBy("split").agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )


@query("O1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
def orders_by_row_id(spark, sf):
    return reader(spark, sf)("orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("O2", "SELECT event_id, value FROM events ORDER BY value, event_id")
def events_by_label(spark, sf):
    return reader(spark, sf)("events").select("event_id", "value").orderBy("value", "event_id")


@query("O3", """
WITH placed AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, o_totalprice FROM placed WHERE pos >= 300 AND pos < 900""")
def positional_slice(spark, sf):
    orders = reader(spark, sf)("orders").select("o_orderkey", "o_totalprice")
    return splits.positional_slice(orders, "o_totalprice", "o_orderkey", 300, 900)


@query("O2 O3 J2", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS position FROM orders""")
def dense_positions(spark, sf):
    orders = reader(spark, sf)("orders").select("o_orderkey", "o_totalprice")
    return ranks.with_dense_index(orders, "o_totalprice", "o_orderkey", name="position").drop("o_totalprice")


@query("O4", f"""
SELECT vec_id, label FROM (SELECT vec_id, label, {hash_sql(SEED, '3', 'vec_id')} AS h FROM embeddings) ORDER BY h, vec_id LIMIT 64""")
def random_batch(spark, sf):
    rows = reader(spark, sf)("embeddings").select("vec_id", "label")
    return splits.random_batch(rows, 64, "vec_id", SEED, step=3)


@query("U1 W6", """
WITH placed AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN pos < n * CAST(0.15 AS DOUBLE) THEN 'low' ELSE 'high' END AS tail FROM placed
WHERE pos < floor(n * CAST(0.15 AS DOUBLE)) OR pos >= floor(n * CAST(0.85 AS DOUBLE))""")
def union_of_tails(spark, sf):
    events = reader(spark, sf)("events").select("event_id", "value")
    edges = lambda n: [int(n * 0.15), int(n * 0.85)]
    n, found = ranks.keys_at_ranks(events, "value", "event_id", edges)
    key, tie = F.col("value"), F.col("event_id")
    low, high = edges(n)
    bottom = events.filter(ranks.before(key, tie, found.get(low))).select("event_id", F.lit("low").alias("tail"))
    top = events.filter(~ranks.before(key, tie, found.get(high))).select("event_id", F.lit("high").alias("tail"))
    return bottom.unionByName(top)


CLASS_COLUMNS = [
    (f"{concept}.{column}", classes) for concept, targets in fv.CONCEPT_LABELS.items() for classes, column in targets
]


@query("A10 M8", """
WITH o AS (SELECT o_orderkey AS id FROM orders), p AS (SELECT p_partkey AS id FROM part), c AS (SELECT c_custkey AS id FROM customer),
counts AS (
  SELECT 'notes.root_note_pitch_class' AS label, 12 AS expected, count(DISTINCT id // 92 % 108 % 12) AS n_classes FROM o UNION ALL
  SELECT 'notes.octave', 9, count(DISTINCT id // 92 % 108 // 12) FROM o UNION ALL
  SELECT 'chords.chord_type', 4, count(DISTINCT id // 276 % 48 % 4) FROM o UNION ALL
  SELECT 'chords.inversion', 3, count(DISTINCT id // 92 % 3) FROM o UNION ALL
  SELECT 'chords.root_note_name', 12, count(DISTINCT id // 276 % 48 // 4) FROM o UNION ALL
  SELECT 'tempos.bpm', 161, count(DISTINCT id // 5 % 161) FROM p UNION ALL
  SELECT 'time_signatures.time_signature', 8, count(DISTINCT id // 15 % 8) FROM c)
SELECT label, n_classes, expected, n_classes = expected AS is_complete FROM counts""")
def class_domain_sizes(spark, sf):
    notes = ds.notes(order_ids(spark, sf))
    chords = ds.chords(order_ids(spark, sf))
    counted = [
        labels.class_counts(notes, {"notes.root_note_pitch_class": "root_note_pitch_class", "notes.octave": "octave"}),
        labels.class_counts(chords, {f"chords.{c}": c for c in ("chord_type", "inversion", "root_note_name")}),
        labels.class_counts(ds.tempos(part_ids(spark, sf)), {"tempos.bpm": "bpm"}),
        labels.class_counts(
            ds.time_signatures(customer_ids(spark, sf)), {"time_signatures.time_signature": "time_signature"}
        ),
    ]
    found = counted[0]
    for more in counted[1:]:
        found = found.unionByName(more)
    wanted = spark.createDataFrame(CLASS_COLUMNS, "label string, expected int")
    return found.join(F.broadcast(wanted), "label").withColumn("is_complete", F.col("n_classes") == F.col("expected"))


@query("J2 W1 S2", """
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS vec_id FROM labels)
SELECT n.vec_id, n.doc_id, n.quality, e.label FROM numbered n JOIN embeddings e USING (vec_id)""")
def positional_join(spark, sf):
    """Row i of the label table with vector i; the position is added because the table has none."""
    t = reader(spark, sf)
    numbered = ranks.with_dense_index(t("labels").select("doc_id", "quality"), "doc_id", name="vec_id")
    return numbered.join(t("embeddings").select("vec_id", "label"), "vec_id")


@query("J2", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)""")
def labelled_documents(spark, sf):
    t = reader(spark, sf)
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id")


@query("J5 S6", f"""
WITH {SPLIT} SELECT e.vec_id, round(list_sum([CAST(x AS DOUBLE) for x in e.embedding]), 6) + 0.0 AS total
FROM embeddings e SEMI JOIN (SELECT vec_id FROM divided WHERE split = 'valid') v ON e.vec_id = v.vec_id""")
def vectors_of_one_split(spark, sf):
    from gridprobe.functions import signal

    vectors = reader(spark, sf)("embeddings")
    ids = splits.shuffle_split(vectors.select("vec_id"), "vec_id", SEED).filter("split = 'valid'")
    chosen = vectors.join(ids, "vec_id", "left_semi")
    return chosen.select("vec_id", rounded(signal.total(signal.widen(F.col("embedding")))).alias("total"))


@query("K2 K1 S2 O1", """
SELECT o_orderkey AS row_id, o_totalprice, o_orderpriority FROM orders""")
def published_table(spark, sf):
    """Written once, ordered by row id, and read back."""
    from gridprobe.session import scratch_path

    rows = reader(spark, sf)("orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderpriority"
    )
    path = scratch_path(spark, "published")
    sinks.publish(rows, path)
    return spark.read.schema(rows.schema).parquet(path)
