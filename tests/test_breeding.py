"""Features of pairs: the plan of their joins, and rows against brute force."""

import itertools

import pytest

from paddock.operators import breeding
from paddock.plans import adapter, catalogue, model_queries

from .compare import SF, ordered

SIDE = ("time_percentile", "earn_percentile", "win_rate", "score", "career_races")


@pytest.mark.parametrize("made", [catalogue.breeding_features, adapter.training_rows, model_queries._pairs, catalogue.QUERIES["class_balance"]], ids=lambda f: f.__name__)
def test_no_task_holds_a_table(spark, made):
    """Tables that grow with the input are merged: none is broadcast, however small its columns look in Parquet, and rows are shuffled instead."""
    frame = made(spark, SF)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan and "ShuffledHashJoin" not in plan


def _key(name):
    return None if name is None else name.strip(" ").upper()


def _brute(pairs, ratings, horses, how):
    """Nested loops over all rows."""
    best = {}
    for name, sire, dam in horses:
        rank = ((sire is not None) + (dam is not None), sire is not None, sire or "", dam is not None, dam or "")
        if name is not None and (_key(name) not in best or rank > best[_key(name)][0]):
            best[_key(name)] = (rank, sire)
    rated = lambda name: [r for r in ratings if name is not None and _key(r[0]) == _key(name)]
    out = []
    for sire, dam in pairs:
        sides = [rated(p) or ([] if how == "inner" else [(None,) * 6]) for p in (sire, dam)]
        ups = [rated(best.get(_key(p), (None, None))[1]) or [(None,) * 6] for p in (dam, sire)]
        for s, m, ds, ss in itertools.product(*sides, *ups):
            out.append((sire, dam, *s[1:], *m[1:], ds[1], ss[1]))
    return ordered(out)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pairs_by_brute_force(spark, how):
    """Shared names fan out on both sides and among their sires; spellings meet; the unknown, the unrated and the nameless are no one's kin."""
    names = ["A", " a ", "B", "B", "C", "D", None, ""]
    ratings = [(n, *(float(10 * i + k) if (i + k) % 4 else None for k in range(4)), i) for i, n in enumerate(names)]
    horses = [("A", "B", "C"), ("a", "B", None), ("B", " c", "X"), ("C", None, "A"), ("D", "X", None), ("X", "A", "B"), ("Y", "D", None), (None, "A", "B"), ("", None, None)]
    pairs = [(s, d) for s in ("A", "b ", "C", "D", "X", "Y", "Z", None, "") for d in ("B", "c", "X", None)]
    got = breeding.pair_features(
        spark.createDataFrame(pairs, "stallion string, mare string"),
        spark.createDataFrame(ratings, "name string, " + ", ".join(f"{c} double" for c in SIDE[:4]) + ", career_races long"),
        spark.createDataFrame(horses, "name string, sire string, dam string"),
        "stallion", "mare", how,
    )
    assert got.columns == ["stallion", "mare", *breeding.FEATURES]
    assert ordered(tuple(r) for r in got.collect()) == [tuple(float(x) if isinstance(x, int) else x for x in r) for r in _brute(pairs, ratings, horses, how)]
