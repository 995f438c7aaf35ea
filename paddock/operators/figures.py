"""How well scores tell: R2, and the area under the curve as a sum of ranks, each from counts that Spark accumulates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranges import running


def r2(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``<by>, r2, n``: one less the share of the label's variation that the scores leave; null if labels do not vary. Rows with a null in either fall out."""
    known = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    left = F.sum((F.col(label) - F.col(score)) ** 2)
    return known.groupBy(*(by or [])).agg((1 - F.try_divide(left, F.var_pop(label) * F.count(F.lit(1)))).alias("r2"), F.count(F.lit(1)).alias("n"))


def area_under_curve(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``<by>, auc, n``: the share of the pairs of a row labelled 1 and one labelled 0 in which the first scores more, ties being half; null without either.

    Pairs are counted by distinct scores: a score's rows of label 1 meet all rows of label 0 below. Rows with a null in either fall out.
    """
    keys = by or []
    known = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(*keys, F.col(score).alias("__s")).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) != 1).alias("__q"))
    upto = running(counts, keys, [F.col("__s").asc()], {"__below": F.col("__q")})
    won = F.sum(F.col("__p") * (F.col("__below") - F.col("__q") / 2.0))
    pairs = F.sum("__p") * F.max("__below_all")
    return upto.groupBy(*keys).agg(F.try_divide(won, pairs.cast("double")).alias("auc"), F.sum(F.col("__p") + F.col("__q")).alias("n"))
