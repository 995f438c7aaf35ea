"""Every query that SQL can express gives the oracle's rows."""

import inspect

import pytest

import __spark_entry__ as contract
from paddock.plans import adapter, catalogue, model_queries, store

from .compare import SF, same


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - {"model_info", "model_earnings"}))  # test_trained_model has these
def test_oracle(spark, name):
    same(spark, catalogue.QUERIES, catalogue.ORACLES, name)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalogue.QUERIES) <= set(contract.queries())
    assert contract.entry(spark).columns


def test_rest_stands_alone():
    """Nothing outside imports the training-data operators."""
    from pathlib import Path

    top = Path(catalogue.__file__).parents[1]
    for file in top.rglob("*.py"):
        if "llm" not in file.relative_to(top).parts:
            assert "llm" not in file.read_text(), file


def test_models_are_trained_whole(spark, monkeypatch):
    """The document is trained with the operator's defaults, 150 rounds and 5 folds, as in the reference, once for all who ask; too few rows give none."""
    asked = []

    def told(*args, **kwargs):
        bound = inspect.signature(train).bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments)

    train = adapter.breeding.train
    monkeypatch.setattr(adapter.breeding, "train", told)
    store.refresh(spark, SF)
    for _ in range(2):
        assert catalogue.QUERIES["train_models"](spark, SF).first().n_samples == 0
    assert [(a["rounds"], a["folds"], a["depth"], a["rate"]) for a in asked] == [(150, 5, 3, 0.08)]
    assert tuple(catalogue.QUERIES["model_info"](spark, SF).first()) == (False, None, None, None, None, None)
    assert catalogue.QUERIES["predict_trained"](spark, SF).count() == catalogue.QUERIES["model_earnings"](spark, SF).count() == 0
    store.refresh(spark, SF)


TRAINED = ("model_info", "model_earnings")


def test_trained_model(spark, monkeypatch):
    """Trained (with few rounds here), written, read, described and used: each pair's score is what the models themselves predict for it."""
    train, made = adapter.breeding.train, []
    monkeypatch.setattr(adapter.breeding, "train", lambda rows: made.append(train(rows, rounds=3, folds=2)) or made[-1])
    store.refresh(spark, SF)
    for name in TRAINED:
        same(spark, catalogue.QUERIES, catalogue.ORACLES, name)
    sides = catalogue.QUERIES["importance_sides"](spark, SF).first()
    given = dict(zip(adapter.breeding.FEATURES, made[0][0].featureImportances.toArray().tolist(), strict=True))
    sire = sum(v for f, v in given.items() if f[:2] == "s_" or f == "ss_time") / sum(given.values()) * 100
    assert sides.sire_share == pytest.approx(sire, abs=0.05) and sides.dam_share == pytest.approx(100 - sire, abs=0.05)
    got = {(r.stallion, r.mare): r for r in catalogue.QUERIES["predict_trained"](spark, SF).collect()}
    from pyspark.ml.feature import VectorAssembler

    breeding = adapter.breeding
    rows = breeding.imputed(model_queries._pairs(spark, SF), breeding.medians(adapter.training_rows(spark, SF)))
    x = VectorAssembler(inputCols=list(breeding.FEATURES), outputCol="x").transform(rows)
    score = {(r.stallion, r.mare): r.prediction for r in made[0][0].transform(x).collect()}
    chance = {(r.stallion, r.mare): float(r.probability[1]) for r in made[0][1].transform(x).collect()}
    assert set(got) == set(score) and len(made) == 1
    for key, r in got.items():
        assert r.predicted_score == pytest.approx(max(0, min(100, score[key])), abs=0.0501) and r.poor_foal_probability == pytest.approx(chance[key], abs=0.000501)
    store.refresh(spark, SF)


def test_too_few_rows_train_nothing(spark):
    """The guard counts the rows: one fewer than the least trains nothing."""
    breeding = adapter.breeding
    rows = [(f"n{i}", "ABCDEF"[i % 6], float(i % 37), *(float((i * (k + 3)) % 101) for k in range(12))) for i in range(30)]
    frame = spark.createDataFrame(rows, "name string, grade string, score double, " + ", ".join(f"{f} double" for f in breeding.FEATURES))
    assert breeding.train(frame, rounds=1, folds=2) is None and breeding.train(frame, rounds=1, folds=2, least=31) is None
    assert breeding.train(frame, rounds=1, folds=2, least=30)[2]["n_samples"] == 30
