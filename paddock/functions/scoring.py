"""Grades, weights, multipliers and the other arithmetic of ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Least scores of the grades of runners, best first; anything else is F.
RUNNER_GRADES = ((97, "SSS"), (90, "SS"), (80, "S"), (65, "A"), (50, "B"), (35, "C"), (20, "D"), (10, "E"))
#: Least scores of the grades of sires in the static mode.
STATIC_SIRE_GRADES = ((85, "SSS"), (72, "SS"), (60, "S"), (48, "A"), (36, "B"), (25, "C"), (15, "D"), (8, "E"))
#: Percentiles whose score begins a grade of sires in the data-driven mode.
SIRE_PERCENTILES = ((97, "SSS"), (92, "SS"), (82, "S"), (65, "A"), (45, "B"), (28, "C"), (15, "D"), (7, "E"))
#: Weight of each grade in a sire's mean.
GRADE_WEIGHTS = {"SSS": 100, "SS": 85, "S": 70, "A": 55, "B": 40, "C": 25, "D": 15, "E": 8, "F": 2}
#: Most progeny at which a multiplier holds; 1 beyond the last.
VOLUME = {1: 0.40, 2: 0.55, 3: 0.65, 4: 0.75, 9: 0.85, 19: 0.92, 49: 0.97}
POOR = ("D", "E", "F")


def rounded(c: Column, digits: int = 2) -> Column:
    """Half up, with a nudge of 1e-9 so that engines agree on values that are a tie but for their last bits."""
    return F.round(c + F.lit(1e-9), digits)


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def graded(score: Column, steps) -> Column:
    """The grade of the first step that the score reaches, else F. Steps are (least score or column, grade)."""
    first = F.when(score >= steps[0][0], steps[0][1])
    return reduce(lambda c, s: c.when(score >= s[0], s[1]), steps[1:], first).otherwise("F")


def runner_grade(score: Column) -> Column:
    return graded(score, RUNNER_GRADES)


def grade_weight(grade: Column) -> Column:
    """0 for an unknown grade."""
    pairs = list(GRADE_WEIGHTS.items())
    return reduce(lambda c, p: c.when(grade == p[0], p[1]), pairs[1:], F.when(grade == pairs[0][0], pairs[0][1])).otherwise(0)


def volume_multiplier(n: Column) -> Column:
    """Few progeny count for less; the single steps up to four are exact, so none at all gets the step of nine."""
    exact = [(F.lit(k) == n if k <= 4 else n <= k, v) for k, v in VOLUME.items()]
    return reduce(lambda c, s: c.when(s[0], s[1]), exact[1:], F.when(exact[0][0], exact[0][1])).otherwise(1.0)


def win_rate(wins: Column, races: Column) -> Column:
    return F.coalesce(F.try_divide(wins * 100.0, races), F.lit(0.0))


def composite(earn: Column, time: Column, rate: Column) -> Column:
    """Half earnings, three tenths time, two tenths win rate, at most 100."""
    return rounded(F.least(earn * 0.5 + time * 0.3 + rate * 0.2, F.lit(100.0)))


def roi(earnings: Column, fee: Column) -> Column:
    """(earnings - fee) / fee, where there is a fee above 0."""
    return half_up(F.when((fee > 0) & earnings.isNotNull(), (earnings - fee) / fee), 2)


def is_poor(grade: Column) -> Column:
    return grade.isin(*POOR).cast("int")


def band(percentile: Column) -> Column:
    """Band of a percentile held within 0 and 100: 90, 70 and 40 begin one."""
    p = clamp(percentile)
    return F.when(p >= 90, "top").when(p >= 70, "high").when(p >= 40, "middle").otherwise("low")
