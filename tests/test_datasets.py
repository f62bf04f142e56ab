"""Label tables: sizes, columns and whole-file digests of the small end-to-end grids."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridprobe import schemas
from gridprobe.functions import dims
from gridprobe.functions import fixed_values as fv
from gridprobe.operators import grid
from gridprobe.plans import datasets as ds

PIANOS = dims.instrument_rows()[:2]
CLICKS = fv.CLICK_CONFIGS[:2]

ROWS = {
    "notes": 9936, "intervals": 39744, "scales": 15456, "chords": 13248,
    "chord_progressions": 20976, "tempos": 4025, "time_signatures": 1200,
}


def offset_time(high):
    random.seed(100)
    return F.lit(random.uniform(0, high))


def build(spark, name):
    ids = lambda *sizes: grid.grid_ids(spark, list(sizes))
    silent = F.lit(False)
    return {
        "notes": lambda: ds.notes(ids(24, 2), range(50, 74), PIANOS, is_silent=silent),
        "intervals": lambda: ds.intervals(ids(20, 3, 2), ds.INTERVALS[:20], PIANOS, is_silent=silent),
        "scales": lambda: ds.scales(ids(84, 2, 2), instruments=PIANOS, is_silent=silent),
        "chords": lambda: ds.chords(ids(48, 3, 2), instruments=PIANOS, is_silent=silent),
        "chord_progressions": lambda: ds.progressions(ids(12, 19, 1), instruments=PIANOS[:1], is_silent=silent),
        "tempos": lambda: ds.tempos(
            ids(20, 2), range(80, 100), CLICKS, 2, is_silent=silent, offset_time=offset_time(16.0)
        ),
        "time_signatures": lambda: ds.time_signatures(
            ids(2, 1, 2), fv.TIME_SIGNATURES[:2], 1, CLICKS, 2, is_silent=silent, offset_time=offset_time(26.0)
        ),
    }[name]()


DIGESTS = {
    "notes": "2d4d02f581cfed960a3b2a30b9343bb04c42eb1c42fffd83ca3198a1d0e22e29",
    "intervals": "9a7203999f4ad937c4ee33eec9d35c53842b46cfb54ed5367cbe2f82886cd4e3",
    "scales": "0529a4eb229be11b59d8507c7808c9a5a4f42542f8891abd97e75e9bde83db24",
    "chords": "fd2ef18e2c59606acbf9f404db594e98c5ee2a8a3ddcd3c071947ff82001086c",
    "chord_progressions": "7b1e179d424977640bb65a806b5ff9486980be9c6b7848edc6b3899bc4b0a5a2",
    "tempos": "eddf9f9fca1ac59dcb0f735f67e96bc62e501961a04201707fb82bb5a08efe8c",
    "time_signatures": "fe386234facc0381f20f7455ed9c66371ba049d1589de895a8c325b36fbcc8e4",
}


@pytest.mark.parametrize("name", DIGESTS)
def test_csv_digest(spark, name):
    text = build(spark, name).orderBy("row_id").toPandas().to_csv(index=False)
    assert hashlib.sha256(text.encode()).hexdigest() == DIGESTS[name]


@pytest.mark.parametrize("name", ROWS)
def test_full_grid(spark, name):
    df = ds.full_table(spark, name)
    assert df.columns == schemas.columns(name)
    n, low, high, distinct = df.agg(
        F.count("*"), F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")
    ).first()
    assert (n, low, high, distinct) == (ROWS[name], 0, ROWS[name] - 1, ROWS[name])


def test_instruments():
    assert len(dims.instrument_rows()) == 128
    assert len(dims.pitched_instrument_rows()) == 92


def test_repeated_progressions_are_refused(spark):
    with pytest.raises(ValueError):
        ds.progressions(grid.grid_ids(spark, [1]), progressions=fv.PROGRESSIONS[:1] * 2)
