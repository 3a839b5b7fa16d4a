"""Moment states: what regressions need of a group of rows, to be stored, merged and solved for any formula.

A state is the number of rows, the mean of every variable and the centred products of
every pair. States of parts of the rows merge into the state of all of them, so that a
day that arrives is added without reading the days before, and every formula over the
variables is solved from the same state.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.operators.models import glance, solved
from backtrail.operators.skew import null_safe_join


def _pairs(variables: Sequence[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(variables)), 2))


def moment_states(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One state per group: ``n``, ``mean`` (in the order of the variables), ``products`` (upper triangle, row by row).

    Only rows with all variables count, so that formulas over some of them are over the same rows.
    """
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in variables]).na.drop(subset=list(variables))
    n = F.count(F.lit(1))
    products = [F.var_pop(variables[i]) if i == j else F.covar_pop(variables[i], variables[j]) for i, j in _pairs(variables)]
    return rows.groupBy(*by).agg(
        n.alias("n"), F.array(*[F.avg(c) for c in variables]).alias("mean"),
        F.array(*[p * n for p in products]).alias("products")).where("n > 0")


def merged_states(states: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The states of coarser groups. Products are taken about the mean of the whole group, so nothing cancels."""
    k = len(variables)
    n = F.col("n").cast("double")
    whole = states.groupBy(*by).agg(
        F.sum("n").alias("__n"), F.array(*[F.sum(n * F.col("mean")[i]) / F.sum(n) for i in range(k)]).alias("__mean"))

    def off(i: int):
        return F.col("mean")[i] - F.col("__mean")[i]

    beside = null_safe_join(states, whole, by)
    return beside.groupBy(*by).agg(
        F.first("__n").alias("n"), F.first("__mean").alias("mean"),
        F.array(*[F.sum(F.col("products")[at] + n * off(i) * off(j)) for at, (i, j) in enumerate(_pairs(variables))]).alias("products"))


def fit_states(states: DataFrame, variables: Sequence[str], y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``models.ols`` of ``y`` on ``xs`` for every state, from its part of the matrix."""
    at = {pair: k for k, pair in enumerate(_pairs(variables))}
    place = [list(variables).index(c) for c in (*xs, y)]
    cells = [at[tuple(sorted((place[i], place[j])))] for i, j in _pairs(place)]
    return solved(states.select(
        *by, "n", F.array(*[F.col("mean")[i] for i in place]).alias("__mean"),
        F.array(*[F.col("products")[c] / F.col("n") for c in cells]).alias("__cov")), len(xs))


def compare_formulas(states: DataFrame, variables: Sequence[str], y: str, formulas: dict[str, Sequence[str]],
                     by: Sequence[str] = ()) -> DataFrame:
    """Quality of several models of ``y``, all from the same states: ``glance`` with the name of the formula."""
    parts = [glance(fit_states(states, variables, y, xs, by), len(xs), by).withColumn("formula", F.lit(name))
             for name, xs in formulas.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
