"""Search over a model's settings: candidates and folds as concurrent jobs under one budget and objective."""

from __future__ import annotations

import random
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models as ML

#: Score of (label, y_pred) rows; the larger, the better, 1 at most.
Objective = Callable[[DataFrame], float]


def macro_f1(labels: list[int]) -> Objective:
    return lambda scored: float(ML.macro_f1(scored, labels).first()["f1_macro"] or 0.0)


def f_beta(target: int, beta: float = 2.0) -> Objective:
    """F-beta of one class, 0 where it is undefined."""

    def score(scored: DataFrame) -> float:
        hit, said, own = ((F.col("label") == target) & (F.col("y_pred") == target), F.col("y_pred") == target, F.col("label") == target)
        tp, p, t = scored.agg(F.count_if(hit), F.count_if(said), F.count_if(own)).first()
        below = beta * beta * t + p
        return (1 + beta * beta) * tp / below if below else 0.0

    return score


def candidates(name: str, n_iter: int, seed: int = 42) -> list[dict]:
    """A seeded subset of the model's grid."""
    grid = [{}]
    for k, values in ML.SPACES[name].items():
        grid = [g | {k: v} for g in grid for v in values]
    return random.Random(seed).sample(grid, min(n_iter, len(grid)))


class Search:
    """The state of a search that its threads share."""

    def __init__(self, n: int, folds: int):
        self.scores: list[list[float | None]] = [[None] * folds for _ in range(n)]
        self.failed, self.dropped, self.lock, self.folds = set(), set(), threading.Lock(), folds

    def mean(self, i: int) -> float | None:
        return sum(self.scores[i]) / self.folds if all(s is not None for s in self.scores[i]) else None

    def best(self) -> int | None:
        done = [(-m, i) for i in range(len(self.scores)) if i not in self.failed and (m := self.mean(i)) is not None]
        return min(done)[1] if done else None

    def can_win(self, i: int) -> bool:
        """Whether candidate i could still beat the best whole one, if all its other folds scored 1."""
        b = self.best()
        return b is None or b == i or sum(1.0 if s is None else s for s in self.scores[i]) / self.folds >= self.mean(b)


def tune(name: str, train: DataFrame, n_classes: int, folds: int, n_iter: int, objective: Objective, *, seed: int = 42, parallel: int = 4, budget: float | None = None, params: list[dict] | None = None) -> tuple[DataFrame, dict]:
    """(candidate, params, score_mean, score_std, status) of each candidate, and the settings of the best, {}
    (the model's defaults) if none could be fitted. train has features, label, weight and `fold`; rows without a fold always train.

    Fits run in `parallel` threads, in a fair scheduler's pool of their own where the session has one. A
    candidate that can't beat the best any more skips its other folds (`dropped`), one that can't be fitted
    is `failed`; after `budget` seconds running jobs are cancelled and the rest is `late`. Ties go to the
    first candidate, so that without a budget the winner is that of a serial search."""
    context = train.sparkSession.sparkContext
    chosen = params if params is not None else candidates(name, n_iter, seed)
    state, tag, over = Search(len(chosen), folds), f"tune-{uuid.uuid4().hex}", threading.Event()

    def run(i: int, k: int) -> None:
        with state.lock:
            if over.is_set() or i in state.failed or not state.can_win(i):
                if not over.is_set() and i not in state.failed:
                    state.dropped.add(i)
                return
        context.addJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", f"fit-{i}")
        try:
            side = F.coalesce(F.col("fold") != k, F.lit(True))
            score = objective(ML.score(ML.fit(name, train.where(side), n_classes, **chosen[i]), train.where(~side)))
            with state.lock:
                state.scores[i][k] = score
        except (PySparkException, Py4JJavaError, ValueError, TypeError):
            if not over.is_set():
                with state.lock:
                    state.failed.add(i)
        finally:
            context.removeJobTag(tag)

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(budget, stop) if budget is not None else None
    if timer:
        timer.daemon = True
        timer.start()
    with ThreadPoolExecutor(parallel) as pool:
        for f in [pool.submit(inheritable_thread_target(train.sparkSession)(run), i, k) for i in range(len(chosen)) for k in range(folds)]:
            f.result()
    if timer:
        timer.cancel()
    rows = []
    for i, p in enumerate(chosen):
        m = None if i in state.failed else state.mean(i)
        std = (sum((s - m) ** 2 for s in state.scores[i]) / folds) ** 0.5 if m is not None else None
        status = "failed" if i in state.failed else "done" if m is not None else "dropped" if i in state.dropped else "late"
        rows.append((i, str(sorted(p.items())), m, std, status))
    table = train.sparkSession.createDataFrame(rows, "candidate int, params string, score_mean double, score_std double, status string")
    best = state.best()
    return table, {} if best is None else chosen[best]
