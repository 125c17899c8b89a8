"""Sequential parameter search with a trial table.

Each trial's parameters come from the trials before it. After some random ones,
the finished trials are parted into the best share and the rest; for every
parameter, values are drawn from a kernel density of the good ones, and the one
with the highest ratio of good to bad density is taken. A trial reports its
metric step by step and is pruned when it falls below the median of the earlier
trials at the same step. Trials are rows of a table, appended as each ends, so
a stopped search goes on where it was, and the same seed gives the same trials.
The winner is read from the table by whatever fits later (:func:`best_params`).

The search itself handles a few numbers per trial; the work is in the objective.
"""
from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vintage.sources.sinks import read_if_there

TRIALS = "trial int, params string, state string, value double, steps array<double>"


class Pruned(Exception):
    """Raised by an objective whose report said to stop."""


@dataclass(frozen=True)
class Dim:
    """One parameter: ``kind`` int, float or log (a float on a logarithmic scale), between lo and hi."""

    name: str
    lo: float
    hi: float
    kind: str = "float"

    def inner(self, x: float) -> float:
        return math.log(x) if self.kind == "log" else float(x)

    def outer(self, z: float) -> float | int:
        x = math.exp(z) if self.kind == "log" else z
        x = min(max(x, self.lo), self.hi)
        return int(round(x)) if self.kind == "int" else x


@dataclass
class Trial:
    trial: int
    params: dict
    state: str  # complete or pruned
    value: float | None
    steps: list[float]


def _density(z: float, centres: Sequence[float], lo: float, hi: float) -> float:
    """Equal mixture of a normal kernel per centre and the uniform density."""
    width = max((hi - lo) / (1 + len(centres)), 1e-9)
    kernels = sum(math.exp(-0.5 * ((z - c) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for c in centres)
    return (kernels + 1 / max(hi - lo, 1e-9)) / (len(centres) + 1)


def suggest(space: Sequence[Dim], trials: Sequence[Trial], seed: int = 42, n_random: int = 5,
            good_share: float = 0.25, candidates: int = 24) -> dict:
    """Parameters of the next trial; a function of the seed and the earlier trials alone."""
    rng = random.Random(f"{seed}-{len(trials)}")
    # pruned trials count as worse than any finished one, by how far they came
    ranked = sorted(trials, key=lambda t: (t.state != "complete", -(t.value if t.value is not None else -math.inf), t.trial))
    n_good = max(1, math.ceil(good_share * len(ranked)))
    good, bad = ranked[:n_good], ranked[n_good:]
    out = {}
    for d in space:
        lo, hi = d.inner(d.lo), d.inner(d.hi)
        if len(trials) < n_random or not bad:
            out[d.name] = d.outer(rng.uniform(lo, hi))
            continue
        g, b = ([d.inner(t.params[d.name]) for t in side] for side in (good, bad))
        width = (hi - lo) / (1 + len(g))
        drawn = [min(max(rng.gauss(rng.choice(g), width), lo), hi) for _ in range(candidates)]
        out[d.name] = d.outer(max(drawn, key=lambda z: _density(z, g, lo, hi) / _density(z, b, lo, hi)))
    return out


def below_median(trials: Sequence[Trial], step: int, value: float, best_so_far: float, n_random: int = 5, warm_up: int = 0) -> bool:
    """Whether a trial whose best value so far is below the median of the earlier ones at ``step`` should stop."""
    if len(trials) < n_random or step < warm_up:
        return False
    seen = sorted(max(t.steps[:step + 1]) for t in trials if len(t.steps) > step)
    if not seen:
        return False
    middle = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2
    return max(value, best_so_far) < middle


def read_trials(spark: SparkSession, path: str) -> list[Trial]:
    """The trials of a table in their order (a few rows)."""
    found = read_if_there(spark, path)
    rows = [] if found is None else found.dropDuplicates(["trial"]).orderBy("trial").collect()
    return [Trial(r.trial, json.loads(r.params), r.state, r.value, list(r.steps)) for r in rows]


def trial_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """Trials as rows."""
    return spark.createDataFrame([(t.trial, json.dumps(t.params, sort_keys=True), t.state, t.value, t.steps) for t in trials], TRIALS)


def search(spark: SparkSession, objective: Callable[[dict, Callable[[int, float], bool]], float], space: Sequence[Dim],
           n_trials: int, path: str, seed: int = 42, n_random: int = 5, warm_up: int = 0) -> list[Trial]:
    """Run trials until the table at ``path`` holds ``n_trials``; the objective is maximised.

    ``objective(params, report)`` returns the value; ``report(step, value)`` says
    whether to stop, and the objective then raises :class:`Pruned`.
    """
    trials = read_trials(spark, path)
    while len(trials) < n_trials:
        params = suggest(space, trials, seed, n_random)
        steps: list[float] = []

        def report(step: int, value: float) -> bool:
            best = max(steps, default=-math.inf)
            steps.append(float(value))
            return below_median(trials, step, value, best, n_random, warm_up)

        try:
            done = Trial(len(trials), params, "complete", float(objective(params, report)), steps)
        except Pruned:
            done = Trial(len(trials), params, "pruned", max(steps, default=None), steps)
        trial_table(spark, [done]).coalesce(1).write.mode("append").parquet(path)
        trials.append(done)
    return trials


def best_params(trials: Sequence[Trial]) -> dict:
    """The parameters of the best finished trial (the earliest of equals)."""
    done = [t for t in trials if t.state == "complete"]
    if not done:
        raise ValueError("no trial finished")
    return max(done, key=lambda t: (t.value, -t.trial)).params
