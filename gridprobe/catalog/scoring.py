"""Probe metrics and run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridprobe.catalog.labelling import SEED, SPLIT
from gridprobe.catalog.registry import query, reader, rounded
from gridprobe.functions import vectors
from gridprobe.operators import metrics, runs, splits

# All elements of a vector fold into the logits of ten classes: logit c sums those at places c, c + 10, and so on. Both
# sides add from left to right, so the sums are equal to the last bit.
FOLDED = "[" + ", ".join("(" + " + ".join(f"CAST(embedding[{i}] AS DOUBLE)" for i in range(c + 1, 65, 10)) + ")" for c in range(10)) + "]"
SCORED = f"""folded AS (SELECT * EXCLUDE (embedding), {FOLDED} AS logits FROM divided),
scored AS (
  SELECT *, list_position(logits, list_max(logits)) - 1 AS pred, ln(list_sum([exp(x) for x in logits])) - logits[label + 1] AS ce FROM folded)"""
PREDICTED = f"""folded AS (SELECT vec_id, label, {FOLDED} AS logits FROM embeddings),
predicted AS (SELECT *, list_position(logits, list_max(logits)) - 1 AS pred FROM folded)"""


def logits():
    """Ten logits from the 64 elements of a vector."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return F.array(*[reduce(lambda a, b: a + b, [at(i) for i in range(c, 64, 10)]) for c in range(10)])


def divided(spark, sf):
    df = splits.shuffle_split(reader(spark, sf)("embeddings"), "vec_id", SEED)
    return df.withColumn("logits", logits())


def predicted(spark, sf):
    df = reader(spark, sf)("embeddings").select("vec_id", "label", logits().alias("logits"))
    return df.withColumn("pred", vectors.argmax(F.col("logits")))


@query("M6 A4 A5 A9 W5 O5", f"""
WITH {SPLIT}, {SCORED}
SELECT split, count(*) AS n, round(avg(ce), 6) + 0.0 AS loss, round(avg(CAST(pred = label AS INT)), 6) + 0.0 AS accuracy,
       round(avg(CAST(pred = label AS INT)), 6) + 0.0 AS f1, round(avg(CAST(pred = label AS INT)), 6) + 0.0 AS primary_eval_metric
FROM scored GROUP BY split""")
def evaluated_splits(spark, sf):
    scored = metrics.classification(divided(spark, sf), "label", "logits", "split")
    return scored.select("split", "n", *[
        rounded(F.col(c)).alias(c) for c in ("loss", "accuracy", "f1", "primary_eval_metric")
    ])


@query("A4 O5 J7", f"""
WITH {PREDICTED} SELECT label, round(avg(CAST(pred = label AS INT)), 6) + 0.0 AS accuracy FROM predicted GROUP BY label""")
def accuracy_per_class(spark, sf):
    scored = metrics.accuracy(predicted(spark, sf), "label", "pred", "label")
    return scored.select("label", rounded(F.col("accuracy")).alias("accuracy"))


@query("A5", f"""
WITH {PREDICTED}, classes AS (SELECT DISTINCT unnest([label, pred]) AS c FROM predicted),
counted AS (
  SELECT c, count(*) FILTER (WHERE label = c AND pred = c) AS tp, count(*) FILTER (WHERE pred = c AND label <> c) AS fp,
         count(*) FILTER (WHERE label = c AND pred <> c) AS fn FROM classes, predicted GROUP BY c)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
       round(sum(tp) / (sum(tp) + (sum(fp) + sum(fn)) / 2.0), 6) + 0.0 AS f1 FROM counted""")
def micro_f1(spark, sf):
    f1 = metrics.micro_f1(predicted(spark, sf), "label", "pred")
    return f1.select("tp", "fp", "fn", rounded(F.col("f1")).alias("f1"))


@query("A6 J7", f"""
WITH {PREDICTED}, present AS (SELECT DISTINCT unnest([label, pred]) AS v FROM predicted)
SELECT CAST(a.v AS INT) AS label, CAST(b.v AS INT) AS prediction, count(p.vec_id) AS n
FROM present a CROSS JOIN present b LEFT JOIN predicted p ON p.label = a.v AND p.pred = b.v GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predicted(spark, sf), "label", "pred")


@query("A9 E8", f"""
WITH {SPLIT}, {SCORED} SELECT vec_id, round(ce, 6) + 0.0 AS loss FROM scored""")
def cross_entropy_rows(spark, sf):
    loss = vectors.cross_entropy(logits(), F.col("label"))
    return reader(spark, sf)("embeddings").select("vec_id", rounded(loss).alias("loss"))


@query("A7 A8 M6", """
WITH scored AS (SELECT l_returnflag, l_quantity AS y, l_extendedprice / 2000.0 AS p FROM lineitem),
centred AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS m FROM scored)
SELECT l_returnflag, count(*) AS n, round(avg((p - y) * (p - y)), 4) + 0.0 AS loss,
       round(1 - sum((p - y) * (p - y)) / sum((y - m) * (y - m)), 6) + 0.0 AS r2 FROM centred GROUP BY l_returnflag""")
def regression_scores(spark, sf):
    lines = reader(spark, sf)("lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("p")
    )
    scored = metrics.regression(lines, "y", "p", "l_returnflag")
    return scored.select(
        "l_returnflag", "n", rounded(F.col("loss"), 4).alias("loss"), rounded(F.col("r2")).alias("r2")
    )


@query("W9", """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_linenumber, l_orderkey) AS r FROM lineitem)
SELECT l_returnflag AS concept, l_linestatus AS model, l_extendedprice AS primary_eval_metric, l_linenumber AS layer, l_orderkey AS config_id
FROM ranked WHERE r = 1""")
def best_layer_per_model(spark, sf):
    rows = reader(spark, sf)("lineitem").select(
        F.col("l_returnflag").alias("concept"), F.col("l_linestatus").alias("model"),
        F.col("l_extendedprice").alias("primary_eval_metric"), F.col("l_linenumber").alias("layer"),
        F.col("l_orderkey").alias("config_id"),
    )
    return metrics.best_per(rows, "primary_eval_metric", ["layer", "config_id"], "concept", "model")


PATIENCE = 20


def _stopping(score: str) -> str:
    return f"""
WITH log AS (SELECT user_id, event_id, {score} AS v, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
topped AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM log),
flagged AS (SELECT *, top IS NULL OR v > top AS better FROM topped),
placed AS (SELECT *, max(CASE WHEN better THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS best_i FROM flagged),
bored AS (SELECT user_id, min(CASE WHEN i - best_i = {PATIENCE} THEN i END) AS bored_i, count(*) AS n_evals FROM placed GROUP BY user_id),
used AS (SELECT p.*, b.bored_i, b.n_evals, p.i <= coalesce(b.bored_i, b.n_evals) AS used FROM placed p JOIN bored b USING (user_id))
SELECT user_id, max(n_evals) AS n_evals, count(*) FILTER (WHERE used) AS n_used, coalesce(min(CASE WHEN i = bored_i + 1 THEN event_id END), -1) AS stop_step,
       arg_max(event_id, i) FILTER (WHERE used AND better) AS best_step, arg_max({{}}, i) FILTER (WHERE used AND better) AS best_score
FROM used GROUP BY user_id"""


@query("W8", _stopping("value").format("v"))
def early_stopping(spark, sf):
    events = reader(spark, sf)("events")
    return runs.early_stopping(events, "user_id", "event_id", "value", PATIENCE).fillna(-1, "stop_step")


@query("W8", _stopping("-value").format("-v"))
def early_stopping_minimised(spark, sf):
    """The same with the sign flipped, over short chunks, so that most runs cross several."""
    events = reader(spark, sf)("events")
    return runs.early_stopping(
        events, "user_id", "event_id", "value", PATIENCE, negate=True, chunk_steps=2000
    ).fillna(-1, "stop_step")


@query("M5 M6 J2", """
WITH scored AS (SELECT d.lang, l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id))
SELECT lang, round(avg(CAST(quality = pred AS INT)), 6) + 0.0 AS accuracy FROM scored GROUP BY lang""")
def rule_accuracy_per_language(spark, sf):
    t = reader(spark, sf)
    joined = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    scored = joined.withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    return metrics.accuracy(scored, "quality", "pred", "lang").withColumn("accuracy", rounded(F.col("accuracy")))
