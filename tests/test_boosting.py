"""Boosting by jobs that all fits share."""

import numpy as np

from paddock.operators import boosting, breeding


def _rows(spark, n=600):
    rows = [(float(i % 23), float(i * 7 % 31), float(i % 23 > 11) * 40 + float(i * 7 % 31), float(i % 23 > 11), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "a double, b double, score double, poor double, fold int")


def test_first_tree_is_the_best_split(spark):
    """One round of depth one: the split and both leaves of the regression are those that numpy finds over all cuts, and the classifier takes a Newton step."""
    rows, frame = _rows(spark)
    made, told = boosting.boost(frame, ("a", "b"), len(rows), 1, 1, 0.5, 3)
    x, y, p = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    cuts = [(((y[c] - y[c].mean()) ** 2).sum() + ((y[~c] - y[~c].mean()) ** 2).sum(), f, t, c) for f in (0, 1) for t in sorted(set(x[:, f]))[:-1] for c in [x[:, f] <= t]]
    _, f, t, c = min(cuts, key=lambda k: k[:3])
    tree, init = made["regressor"].trees[0], made["regressor"].init
    assert np.isclose(init, y.mean()) and (tree.f, tree.th) == ([f], [t])
    assert np.allclose(tree.lf, [y[c].mean() - init, y[~c].mean() - init])
    share, q = p.mean(), made["classifier"].trees[0]
    left = x[:, q.f[0]] <= q.th[0]
    assert np.allclose(q.lf, [(p[s] - share).sum() / (share * (1 - share) * s.sum()) for s in (left, ~left)])
    held = told.filter("fold = 1").first()
    seen = np.array([r[4] for r in rows]) != 1
    assert told.count() == len(rows) and abs(held.regressor - y[seen].mean()) > 0.1


def test_jobs_do_not_grow_with_the_fits(spark):
    """All models and folds share a job a level: with three times as many folds there are no more jobs (each fit had its own)."""
    features = breeding.FEATURES
    rows = [(f"n{i}", "ABCDEF"[i % 6], float(i % 37), *(float((i * (k + 3)) % 101) for k in range(12))) for i in range(200)]
    frame = spark.createDataFrame(rows, "name string, grade string, score double, " + ", ".join(f"{f} double" for f in features))
    jobs, tracker = [], spark.sparkContext.statusTracker()
    for folds in (2, 6):
        spark.sparkContext.setJobGroup(f"boost-{folds}", "")
        regressor, classifier, figures = breeding.train(frame, rounds=3, folds=folds)
        assert len(regressor.trees) == len(classifier.trees) == 3 and figures["n_samples"] == 200
        jobs.append(len(tracker.getJobIdsForGroup(f"boost-{folds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 5
