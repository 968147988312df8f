"""Feed-forward networks trained across tasks: every step sums gradients over all partitions, then moves the weights.

A network has one input or two (towers whose projections are multiplied), several outputs, and a loss over the labels
that are there. Rows stay where they are; a step sends the weights out and gets their gradient back, both of the size of
the network. Several networks (members of an ensemble, trials of a search) are trained in the same jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.operators.models import warmup_rate
from gridlark.operators.sums import added, as_array
from gridlark.sources.shared import forget, written

#: Numbers of a gradient that are summed as one row.
CHUNK = 4096
U64 = np.uint64


@dataclass(frozen=True)
class Network:
    """What a network looks like and how it is trained."""

    inputs: tuple[int, ...]
    outputs: int = 1
    hidden: int = 50
    layers: int = 3
    dropout: float = 0.1
    decay: float = 0.0
    rate: float = 1e-3
    regression: bool = False
    warmup: int = 0
    seed: int = 0

    def shapes(self) -> list[tuple[int, int]]:
        """Sizes of all layers: the towers, the inner layers, the output."""
        return [*((d, self.hidden) for d in self.inputs), *[(self.hidden, self.hidden)] * (self.layers - 1), (self.hidden, self.outputs)]

    def start(self) -> np.ndarray:
        """All weights, one after another."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return np.concatenate([x for a, b in self.shapes() for x in (rng.uniform(-1, 1, a * b) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a))])

    def parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the weights and biases of each layer."""
        out, at = [], 0
        for a, b in self.shapes():
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out


@dataclass
class Trained:
    """A network with its best weights; history has its validation loss before training and after each epoch."""

    network: Network
    weights: np.ndarray
    history: list[float] = field(default_factory=list)
    best_epoch: int = 0


def _kept(ids: np.ndarray, units: int, layer: int, step: int, seed: int, share: float) -> np.ndarray:
    """Which units of which rows stay in a step; it follows from the row's id, not from where the row is."""
    column = np.arange(units, dtype=U64) + U64((seed * 1_000_003 + step) * 64 + layer) * U64(1 << 20)
    with np.errstate(over="ignore"):
        x = ids[:, None] * U64(0x9E3779B97F4A7C15) ^ column[None, :] * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(31)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(29)
    return (x >> U64(11)).astype(np.float64) / 2.0**53 >= share


def forward(net: Network, flat: np.ndarray, inputs: list[np.ndarray], ids: np.ndarray | None = None, step: int = 0) -> tuple[np.ndarray, list]:
    """Outputs, and what the way back needs. With ids, units are left out as in training."""
    parts, n = net.parts(flat), len(net.inputs)
    towers = [x @ w + b for x, (w, b) in zip(inputs, parts, strict=False)]
    h = towers[0] if n == 1 else towers[0] * towers[1]
    trace: list = [towers]
    for layer, (w, b) in enumerate(parts[n:]):
        active = np.maximum(h, 0)
        z = active @ w + b
        scale = 1.0
        if ids is not None and net.dropout and layer < net.layers - 1:
            scale = _kept(ids, z.shape[1], layer, step, net.seed, net.dropout) / (1 - net.dropout)
            z = z * scale
        trace.append((h, active, scale))
        h = z
    return h, trace


def loss_and_slope(net: Network, z: np.ndarray, y: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Summed loss over the labels that are not NaN, their number, and the slope of the sum."""
    seen = ~np.isnan(y)
    t = np.where(seen, y, 0.0)
    if net.regression:
        each, slope = (z - t) ** 2, 2 * (z - t)
    else:
        each, slope = np.logaddexp(0, z) - t * z, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - t
    return float(each[seen].sum()), int(seen.sum()), np.where(seen, slope, 0.0)


def gradient(net: Network, flat: np.ndarray, inputs: list[np.ndarray], y: np.ndarray, ids: np.ndarray, step: int) -> np.ndarray:
    """The summed gradient, then the summed loss and the number of labels."""
    z, trace = forward(net, flat, inputs, ids, step)
    loss, seen, g = loss_and_slope(net, z, y)
    parts, n, out = net.parts(flat), len(net.inputs), []
    for (w, _), (h, active, scale) in zip(reversed(parts[n:]), reversed(trace[1:]), strict=True):
        g = g * scale
        out = [(active.T @ g).ravel(), g.sum(axis=0), *out]
        g = (g @ w.T) * (h > 0)
    towers = trace[0]
    back = []
    for k, x in enumerate(inputs[:n]):
        own = g if n == 1 else g * towers[1 - k]
        back += [(x.T @ own).ravel(), own.sum(axis=0)]
    return np.concatenate([*back, *out, [loss, seen]])


class Adam:
    """The moving averages of a network's gradients; lives in the driver, as large as the network."""

    def __init__(self, net: Network, steps: int):
        self.net, self.steps, self.t = net, steps, 0
        self.m = self.v = np.zeros(len(net.start()))

    def move(self, flat: np.ndarray, total: np.ndarray) -> np.ndarray:
        net, self.t = self.net, self.t + 1
        g = total[:-2] / max(total[-1], 1) + net.decay * flat
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        rate = warmup_rate(self.t, net.warmup, self.steps, net.rate / 10, net.rate, net.rate / 10) if net.warmup else net.rate
        return flat - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _slopes(nets: list[Network], weights: list[np.ndarray], step: int, train: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray | None] = [None] * len(nets)
        for rows in batches:
            if not rows.num_rows:
                continue
            ids, y, *inputs = rows.column(0).to_numpy().view(U64), as_array(rows.column(1)), *map(as_array, rows.columns[2:])
            for k, (net, flat) in enumerate(zip(nets, weights, strict=True)):
                got = gradient(net, flat, inputs, y, ids, step) if train else np.array(loss_and_slope(net, forward(net, flat, inputs)[0], y)[:2], dtype=float)
                totals[k] = got if totals[k] is None else totals[k] + got
        for k, total in enumerate(totals):
            if total is not None:
                padded = np.append(total, np.zeros(-len(total) % CHUNK))
                n = len(padded) // CHUNK
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, type=pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CHUNK), pa.array(padded))], names=["net", "chunk", "sums"])

    return run


def _totals(rows: DataFrame, nets: list[Network], weights: list[np.ndarray], step: int, train: bool) -> list[np.ndarray]:
    """Sums over all rows for each network; what reaches the driver is as large as the networks."""
    found = added(rows.mapInArrow(_slopes(nets, weights, step, train), "net int, chunk int, sums array<double>"), ["net", "chunk"])
    sizes = [len(w) + 2 if train else 2 for w in weights]
    out = [np.zeros(-(-s // CHUNK) * CHUNK) for s in sizes]
    for r in found.collect():
        out[r["net"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["sums"]
    return [o[:s] if train else o[:2] for o, s in zip(out, sizes, strict=True)]


def fit_networks(rows: DataFrame, nets: list[Network], key: str, inputs: list[str], labels: str = "labels", role: str = "role", epochs: int = 5, batches: int = 1) -> list[Trained]:
    """Trains all networks on the rows of role train; of each, the weights of the epoch with the least validation loss.

    Rows have one or two feature arrays and an array of labels, null where there is none. They are dealt once, by a hash
    of the key, into `batches` folders of the shared folder: a step reads one of them and an epoch all. With one batch an
    epoch is one step over everything. Without validation rows the last epoch counts."""
    x = [F.col(c).cast("array<double>").alias(f"x{k}") for k, c in enumerate(inputs)]
    marked = rows.select(F.xxhash64(key).alias("id"), F.col(labels).cast("array<double>").alias("y"), *x, F.col(role).alias("role"))
    dealt = written(marked.where("role in ('train', 'val')").select("id", "y", *(f"x{k}" for k in range(len(inputs))), "role", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch")), "role", "batch")
    columns = ["id", "y", *(f"x{k}" for k in range(len(inputs)))]
    val = dealt.where("role = 'val'").select(*columns)
    weights, adams = [n.start() for n in nets], [Adam(n, epochs * batches) for n in nets]
    best = [Trained(n, w) for n, w in zip(nets, weights, strict=True)]

    def judge(epoch: int) -> None:
        for k, (loss, seen) in enumerate(_totals(val, nets, weights, 0, False)):
            mean = float(loss / seen) if seen else float("nan")
            if not epoch or np.isnan(mean) or mean < min(best[k].history):
                best[k].weights, best[k].best_epoch = weights[k], epoch
            best[k].history.append(mean)

    judge(0)
    for epoch in range(1, epochs + 1):
        for b in range(batches):
            part = dealt.where(f"role = 'train' and batch = {b}").select(*columns)
            totals = _totals(part, nets, weights, (epoch - 1) * batches + b, True)
            weights = [a.move(w, t) if t[-1] else w for a, w, t in zip(adams, weights, totals, strict=True)]
        judge(epoch)
    forget(dealt)
    return best


def predict_networks(rows: DataFrame, trained: list[Trained], key: str, inputs: list[str]) -> DataFrame:
    """(key, pred, spread): arrays by output, mean and population deviation over the networks; probabilities unless
    regression."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [as_array(c) for c in batch.columns[1:]]
            z = [forward(t.network, t.weights, x)[0] for t in trained] if batch.num_rows else [np.zeros((0, 1))]
            p = np.stack([v if t.network.regression else 1 / (1 + np.exp(-np.clip(v, -500, 500))) for v, t in zip(z, trained, strict=False)])
            as_lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(p.mean(axis=0)), as_lists(p.std(axis=0))], names=[key, "pred", "spread"])

    return rows.select(key, *(F.col(c).cast("array<double>") for c in inputs)).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, pred array<double>, spread array<double>")


def loss_history(trained: list[Trained], spark) -> DataFrame:
    """(member, epoch, loss, best): validation losses of each network."""
    found = [(k, e, v, e == t.best_epoch) for k, t in enumerate(trained) for e, v in enumerate(t.history)]
    return spark.createDataFrame(found, "member int, epoch int, loss double, best boolean")


def save_networks(trained: list[Trained], spark, path: str) -> None:
    """Networks as a table: what each looks like, its weights and its losses."""
    rows = [(k, json.dumps(asdict(t.network)), t.weights.tolist(), [float(x) for x in t.history], int(t.best_epoch)) for k, t in enumerate(trained)]
    spark.createDataFrame(rows, "member int, network string, weights array<double>, history array<double>, best_epoch int").write.parquet(path)


def load_networks(spark, path: str) -> list[Trained]:
    found = spark.read.parquet(path).orderBy("member").collect()  # as large as the networks
    made = [Network(**{k: tuple(v) if k == "inputs" else v for k, v in json.loads(r["network"]).items()}) for r in found]
    return [Trained(n, np.array(r["weights"]), list(r["history"]), r["best_epoch"]) for n, r in zip(made, found, strict=True)]
