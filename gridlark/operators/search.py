"""Search over mixed ranges that learns from past trials; all trials of a round are scored by one call.

Past trials are split into the best quarter and the rest. For each parameter, both have a density, a mixture of bumps at
their values and a flat part; of values drawn from the better density, the one with the greatest ratio is tried."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Range:
    """Numbers from low to high; whole ones by step, or on a logarithmic scale."""

    low: float
    high: float
    step: int = 0
    log: bool = False

    def _ends(self) -> tuple[float, float]:
        return (np.log(self.low), np.log(self.high)) if self.log else (self.low - self.step / 2, self.high + self.step / 2)

    def place(self, value: float) -> float:
        """Where a value is, from 0 to 1."""
        a, b = self._ends()
        return float(((np.log(value) if self.log else value) - a) / (b - a))

    def value(self, place: float) -> float | int:
        a, b = self._ends()
        x = a + (b - a) * min(max(place, 0.0), 1.0)
        if self.log:
            return float(min(max(np.exp(x), self.low), self.high))
        if self.step:
            count = int((self.high - self.low) // self.step)
            return int(self.low + self.step * min(max(round((x - self.low) / self.step), 0), count))
        return float(x)


Trial = dict[str, float]

#: The ranges that results have to be searched over.
SEARCH_SPACES: dict[str, dict[str, Range]] = {
    "knn": {"k": Range(1, 10, 1)},
    "linear": {"log_alpha": Range(-3, 4, 1)},
    "rf": {"depth": Range(1, 5, 1), "trees": Range(1, 1000, 1)},
    "network": {"dropout": Range(0.0, 0.2), "decay": Range(0.0, 0.01), "hidden": Range(10, 90, 20), "layers": Range(1, 2, 1), "rate": Range(1e-5, 1e-3, log=True)},
}


def random_trials(space: dict[str, Range], n: int, rng: np.random.Generator) -> list[Trial]:
    return [{k: r.value(rng.random()) for k, r in space.items()} for _ in range(n)]


def _density(x: np.ndarray, centres: np.ndarray, width: float) -> np.ndarray:
    """Bumps at the centres and one flat part of the weight of a bump, on [0, 1]."""
    bumps = np.exp(-0.5 * ((x[:, None] - centres[None, :]) / width) ** 2) / (width * np.sqrt(2 * np.pi))
    return (bumps.sum(axis=1) + 1) / (len(centres) + 1)


def proposals(space: dict[str, Range], past: list[tuple[Trial, float]], n: int, rng: np.random.Generator, draws: int = 24) -> list[Trial]:
    """n trials to make next; at random until there are enough past ones. Trials without a finite score count as worst."""
    scored = sorted(((s if np.isfinite(s) else np.inf, i) for i, (_, s) in enumerate(past)))
    if len(scored) < 8:
        return random_trials(space, n, rng)
    good = max(2, len(scored) // 4)
    out: list[Trial] = []
    for _ in range(n):
        trial: Trial = {}
        for name, r in space.items():
            places = np.array([r.place(past[i][0][name]) for _, i in scored])
            best, rest = places[:good], places[good:]
            width = max(1.0 / (1 + len(best)), 0.05)
            centre = best[rng.integers(0, len(best), draws)]
            x = np.where(rng.random(draws) < 1 / (len(best) + 1), rng.random(draws), np.clip(centre + width * rng.standard_normal(draws), 0, 1))
            ratio = _density(x, best, width) / _density(x, rest, max(1.0 / (1 + len(rest)), 0.05))
            trial[name] = r.value(float(x[int(np.argmax(ratio))]))
        out.append(trial)
    return out


def search(space: dict[str, Range], score: Callable[[list[Trial]], list[float]], rounds: int = 4, per_round: int = 8, seed: int = 1, learn: bool = True) -> list[tuple[Trial, float]]:
    """All trials with their scores, in the order they were made; the least score is the best.

    score gets the different trials of a round at once and scores them as rows of one job. The same seed makes the same
    trials; trials made before are not scored again."""
    rng = np.random.Generator(np.random.PCG64(seed))
    past: list[tuple[Trial, float]] = []
    known: dict[tuple, float] = {}
    for _ in range(rounds):
        trials = proposals(space, past, per_round, rng) if learn else random_trials(space, per_round, rng)
        fresh = list({tuple(t.values()): t for t in trials if tuple(t.values()) not in known}.values())
        if fresh:
            known |= {tuple(t.values()): float(s) for t, s in zip(fresh, score(fresh), strict=True)}
        past += [(t, known[tuple(t.values())]) for t in trials]
    return past


def best_trial(past: list[tuple[Trial, float]]) -> tuple[Trial, float]:
    return min(past, key=lambda x: x[1] if np.isfinite(x[1]) else np.inf)
