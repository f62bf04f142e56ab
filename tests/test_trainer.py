"""First-order training against plain loops, alone and in a sweep; early stopping; saved probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridprobe.operators import runs, sweeps
from gridprobe.plans import probes, sweep, trainer
from gridprobe.sources.configs import ProbeConfig


def config(outputs=3, **hyper):
    given = {"max_num_epochs": 3, "early_stopping": False, "dropout_p": 0.0} | hyper
    return ProbeConfig(dataset="d", dataset_embeddings_label_column_name="label", model_hash="m", num_outputs=outputs, **given)


def table(spark, regression=False, n=150):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1.5, (n, 4)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n)) / 9 if regression else (x[:, 0] > 2) + (x[:, 1] > 2)
    split = lambda i: "train" if i % 10 < 7 else "valid" if i % 10 < 9 else "test"
    rows = [(i, float(y[i]), x[i].tolist(), split(i)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y double, embedding array<float>, split string").cache()


@pytest.fixture(scope="module")
def classes(spark):
    return table(spark)


@pytest.fixture(scope="module")
def values(spark):
    return table(spark, regression=True)


def plain(x, y, cfg, regression, passes=None, shard=0, start=None, steps=0, first_pass=0):
    """Adam over mini-batches, layer by layer, in double precision; draws in the order the trainer states."""
    x, y = np.asarray(x, np.float64), np.asarray(y)
    if start is None:
        net = trainer.Network.initial(x.shape[1], cfg["hidden_layer_sizes"], cfg["num_outputs"], cfg["seed"])
        params = [p.astype(np.float64) for layer in net.layers for p in layer]
        start = params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    params, m, v = ([p.copy() for p in part] for part in start)
    keep, decay = 1 - (cfg["dropout_p"] or 0), cfg["l2_weight_decay"] or 0
    for number in range(first_pass, first_pass + (passes or cfg["max_num_epochs"])):
        rng = np.random.default_rng([cfg["seed"], 1, number, shard])
        order = rng.permutation(len(x))
        for at in range(0, len(x), cfg["batch_size"]):
            rows = order[at : at + cfg["batch_size"]]
            h, inputs, masks = x[rows], [], []
            for i in range(0, len(params), 2):
                mask = (rng.random(h.shape, np.float32) >= 1 - keep) / keep if keep < 1 else np.ones(h.shape)
                h = h * mask
                inputs.append(h)
                masks.append(mask)
                h = h @ params[i] + params[i + 1]
                if i + 2 < len(params):
                    h = np.maximum(h, 0)
            if regression:
                d = 2 * (h - y[rows][:, None]) / len(rows)
            else:
                p = np.exp(h - h.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows].astype(int)] -= 1
                d = p / len(rows)
            gradients = [None] * len(params)
            for i in range(len(params) - 2, -1, -2):
                gradients[i], gradients[i + 1] = inputs[i // 2].T @ d, d.sum(0)
                if i:
                    d = (d @ params[i].T) * masks[i // 2] * (inputs[i // 2] > 0)
            steps += 1
            for k, g in enumerate(gradients):
                g = g + decay * params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= cfg["learning_rate"] * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)
    return params, m, v


def training_rows(rows):
    found = rows.filter("split = 'train'").orderBy("row_id").collect()
    return np.array([r["embedding"] for r in found]), np.array([r["y"] for r in found])


def flat(parts):
    return np.concatenate([p.ravel() for p in parts])


@pytest.mark.parametrize("hyper", [
    {}, {"hidden_layer_sizes": [8]}, {"hidden_layer_sizes": [6, 5], "dropout_p": 0.25, "l2_weight_decay": 0.1, "batch_size": 16},
    {"data_standardization": False, "learning_rate": 1e-2, "seed": 4},
])
def test_one_shard_is_the_plain_loop(classes, hyper):
    cfg = config(**hyper)
    x, y = training_rows(classes)
    if cfg["data_standardization"]:
        x = (x - x.mean(0)) / x.std(0)
    got = trainer.train(classes, [cfg], "multiclass")[0]
    assert got.model.flat() == pytest.approx(flat(plain(x, y, cfg, False)[0]), abs=2e-5)


def test_regression_is_the_plain_loop(values):
    cfg = config(1, hidden_layer_sizes=[7], batch_size=32, max_num_epochs=4)
    x, y = training_rows(values)
    got = trainer.train(values, [cfg], "regression")[0]
    assert got.model.flat() == pytest.approx(flat(plain((x - x.mean(0)) / x.std(0), y, cfg, True)[0]), abs=2e-5)


def test_shards_are_averaged_by_rows(spark, classes, monkeypatch):
    monkeypatch.setattr(trainer, "SHARD_ROWS", 40)
    cfg = config(max_num_epochs=2, batch_size=10, data_standardization=False)
    got = trainer.train(classes, [cfg], "multiclass")[0]
    train = classes.filter("split = 'train'")
    shards = -(-train.count() // 40)
    dealt = train.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)))
    parts = [(*training_rows(dealt.filter(F.col("shard") == s)), s) for s in range(shards)]
    assert shards > 1 and len(parts) == shards
    state, steps = None, 0
    for number in range(2):
        moved = [plain(x, y, cfg, False, 1, s, state, steps, number) for x, y, s in parts]
        sizes = np.array([len(y) for _, y, _ in parts])
        state = tuple([sum(n * m[kind][i] for n, m in zip(sizes, moved)) / sizes.sum() for i in range(2)] for kind in range(3))
        steps += 4
    assert got.model.flat() == pytest.approx(flat(state[0]), abs=2e-5)


def test_every_setting_acts_and_none_changes_with_company(classes):
    """Fits of a sweep in one scan equal those made one by one, and all differ."""
    base = {"hidden_layer_sizes": [5], "dropout_p": 0.25}
    others = [{"data_standardization": False}, {"hidden_layer_sizes": []}, {"batch_size": 16}, {"learning_rate": 1e-2},
              {"dropout_p": 0.5}, {"l2_weight_decay": 1e-2}]
    made = [config(**base), *[config(**base | o) for o in others]]
    together = trainer.train(classes, made, "multiclass")
    losses = [p.metrics["train"]["loss"] for p in together]
    assert len({round(x, 7) for x in losses}) == len(made)
    for k in (0, 2, 6):
        alone = trainer.train(classes, [made[k]], "multiclass")[0]
        assert np.array_equal(alone.model.flat(), together[k].model.flat()) and alone.metrics == together[k].metrics


def test_lots_change_nothing(classes, monkeypatch):
    made = [config(seed=s) for s in range(3)]
    whole = [p.model.flat() for p in trainer.train(classes, made, "multiclass")]
    monkeypatch.setattr(trainer, "STATE_BYTES", 500)
    assert len(list(trainer._lots([trainer.Settings.of(c, 4, "multiclass") for c in made]))) == 3
    assert np.array_equal(whole, [p.model.flat() for p in trainer.train(classes, made, "multiclass")])


@pytest.mark.parametrize("kind", ["multiclass", "regression"])
def test_metrics_agree_with_the_operators(classes, values, kind):
    rows, cfg = (classes, config()) if kind == "multiclass" else (values, config(1))
    probe = trainer.train(rows, [cfg], kind)[0]
    for r in probes.evaluate(probe, rows, "split").collect():
        for name, value in probe.metrics[r["split"]].items():
            assert r[name] == pytest.approx(value, rel=1e-5)


def test_early_stopping_and_saved_probe(spark, classes, tmp_path):
    cfg = config(early_stopping=True, early_stopping_boredom=2, early_stopping_eval_frequency=4, max_num_epochs=40,
                 learning_rate=0.3, early_stopping_metric="-loss")
    probe = trainer.train(classes, [cfg], "multiclass")[0]
    assert probe.log[0]["step"] == 0 and probe.log[-1]["boredom"] == 2 and len(probe.log) < 40
    log = spark.createDataFrame([("r", e["step"], e["score"]) for e in probe.log], "run string, step long, score double")
    stop = runs.early_stopping(log, "run", "step", "score", patience=2).first()
    assert stop["best_score"] == probe.log[-1]["best_score"] == pytest.approx(-probe.metrics["valid"]["loss"], rel=1e-6)
    uid = probes.save(spark, probe, str(tmp_path))
    again = probes.load(spark, uid[:9], str(tmp_path))
    read = lambda p: {r["row_id"]: (r["prediction"], r["logits"]) for r in p.score(classes).collect()}
    assert read(again) == read(probe) and again.config == cfg
    assert sum(r["n"] for r in probes.confusion(again, classes).collect()) == 150
    probes.delete(spark, cfg, str(tmp_path), delete_metrics_and_config=True)
    assert not list(tmp_path.glob("d/*/*.json"))


def test_faults(spark, classes):
    with pytest.raises(ValueError, match="Unsupported output type"):
        trainer.train(classes, [config()], "ranking")
    with pytest.raises(ValueError, match="no training rows"):
        trainer.train(classes.filter("split = 'valid'"), [config()], "multiclass")
    with pytest.raises(ValueError, match="needs validation rows"):
        trainer.train(classes.filter("split = 'train'"), [config(early_stopping=True)], "multiclass")


def test_sweep_of_all_settings(spark, classes, tmp_path):
    """Every combination has metrics of its own, stored once."""
    grid = sweeps.expand_space(spark.range(16).withColumnRenamed("id", "config_id"), {
        "model_type": ("JUKEBOX",), "model_size": ("L",), "model_layer": (0,), "concept": ("chords",),
        "hidden_layer_sizes": ((), (4,)), "l2_weight_decay": (None, 1e-2), "learning_rate": (1e-2, 1e-3), "dropout_p": (0.25, 0.5),
    }).withColumn("num_classes", F.lit(3))
    exports = spark.createDataFrame([("a", "chords", "L", "JUKEBOX", 72)], "path string, concept string, model_size string, model_type string, n_layers int")
    path = str(tmp_path / "metrics")
    for _ in range(2):
        done = sweep.run_sweep(spark, grid, exports, lambda *_: classes, path, solver="adam", max_num_epochs=2, early_stopping=False)
    losses = done.filter("split = 'train' AND metric = 'loss'")
    assert losses.count() == 16 and losses.select("uid").distinct().count() == 16
    assert losses.select(F.round("value", 7)).distinct().count() == 16
    with pytest.raises(ValueError, match="unknown solver"):
        sweep.run_sweep(spark, grid, exports, None, path, solver="x")
