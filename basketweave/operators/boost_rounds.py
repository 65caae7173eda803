"""Boosting of classification trees that goes on from the trees it has: each tree is grown once.

A row's margin is stored next to its features. A round adds what the trees since then say, fits one tree to the residual
of the logistic loss, and looks at the validation part; the margins are stored anew every ``STORE_EVERY`` rounds, so plans
stay short, at most that many trees are evaluated in a round, and the wide rows are rarely written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketweave.session import drop_stage, write_stage

STORE_EVERY = 10


class Margins:
    """Rows ``features, y`` (y is 1 or -1) and the margin that an ensemble gives them so far."""

    def __init__(self, rows: DataFrame, name: str, ensemble: Callable[[Sequence, Sequence[float]], object]):
        """``rows``: features, label (0 or 1). ``ensemble`` makes a model of trees and their weights."""
        self.ensemble, self.name = ensemble, name
        self.trees, self.weights = [], []
        start = rows.select("features", (F.col("label") * 2 - 1).cast("double").alias("y"), F.lit(0.0).alias("margin"))
        self.stored, self.path = write_stage(start, name)

    def rows(self) -> DataFrame:
        if not self.trees:
            return self.stored
        added = self.ensemble(self.trees, self.weights).setPredictionCol("_added").transform(self.stored)
        return added.select("features", "y", (F.col("margin") + F.col("_added")).alias("margin"))

    def add(self, tree, weight: float) -> None:
        self.trees.append(tree)
        self.weights.append(weight)
        if len(self.trees) == STORE_EVERY:
            stored, path = write_stage(self.rows(), self.name)
            self.drop()
            self.stored, self.path, self.trees, self.weights = stored, path, [], []

    def drop(self) -> None:
        drop_stage(self.stored.sparkSession, self.path)


def row_loss() -> Column:
    """2 log(1 + exp(-2 y F)), as MLlib has it, without overflow."""
    x = -2.0 * F.col("y") * F.col("margin")
    return 2.0 * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def residual() -> Column:
    """The loss's negative gradient in the margin."""
    return 4.0 * F.col("y") / (1.0 + F.exp(F.least(2.0 * F.col("y") * F.col("margin"), F.lit(700.0))))


def fit_rounds(
    train: DataFrame, valid: DataFrame, learner: RandomForestRegressor, step: float, patience: int, seed: int, ensemble: Callable
) -> tuple[list, list[float], list[float]]:
    """``(trees, weights, losses)``: trees up to the best round on ``valid``, and the losses of all rounds.

    The first tree fits the labels and weighs 1, later ones fit residuals and weigh ``step``. It ends once ``patience`` rounds
    brought no gain, so as many trees are grown as are kept, and ``patience`` more.
    """
    mine, theirs = Margins(train, "boost-train", ensemble), Margins(valid, "boost-valid", ensemble)
    trees, losses, best_at = [], [], 0
    while len(losses) - 1 - best_at < patience or not losses:
        target = residual() if trees else F.col("y")
        fitted_on = mine.rows().select("features", target.alias("label"))
        tree = learner.copy().setSeed(seed + len(trees)).fit(fitted_on).trees[0]
        weight = step if trees else 1.0
        trees.append(tree)
        for side in (mine, theirs):
            side.add(tree, weight)
        losses.append(theirs.rows().agg(F.avg(row_loss())).first()[0])
        if losses[-1] < losses[best_at]:
            best_at = len(losses) - 1
    mine.drop()
    theirs.drop()
    kept = best_at + 1
    return trees[:kept], [1.0] + [step] * (kept - 1), losses
