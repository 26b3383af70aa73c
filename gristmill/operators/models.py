"""Training and evaluation of the classifier on vectors: a perceptron by Adam with early stopping, its gradients summed over all executors."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import work_folder

HIDDEN = (256, 128, 64)
RUN = "run int, model binary, epochs int, val_loss double, val_accuracy double"
#: Rows that a task takes through the layers at once, and numbers of a gradient that travel together.
ROWS, BLOCK = 4096, 4096


@dataclass
class Perceptron:
    """Layers of (weights, biases): rectified hidden units, one sigmoid at the end."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def new(cls, sizes: list[int], rng: np.random.Generator) -> Perceptron:
        bound = [n**-0.5 for n in sizes[:-1]]
        return cls([(rng.uniform(-b, b, (n, m)), rng.uniform(-b, b, m)) for b, n, m in zip(bound, sizes, sizes[1:])])

    @classmethod
    def of(cls, sizes: list[int], flat: np.ndarray) -> Perceptron:
        """From all parameters in one vector."""
        layers, at = [], 0
        for n, m in zip(sizes, sizes[1:]):
            layers.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
            at += n * m + m
        return cls(layers)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for w, b in self.layers[:-1]:
            out.append(np.maximum(out[-1] @ w + b, 0))
        w, b = self.layers[-1]
        return [*out, 1 / (1 + np.exp(-np.clip(out[-1] @ w + b, -60, 60)))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.activations(np.asarray(x, float))[-1][:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the summed cross entropy, in the order of ``flat``."""
        acts = self.activations(x)
        delta, out = acts[-1] - y[:, None], []
        for (w, _), a in zip(self.layers[::-1], acts[-2::-1]):
            out += [delta.sum(axis=0), (a.T @ delta).ravel()]
            delta = (delta @ w.T) * (a > 0)
        return np.concatenate(out[::-1])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *(p for layer in self.layers for p in layer))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Perceptron:
        with np.load(io.BytesIO(raw)) as f:
            p = [f[f"arr_{i}"] for i in range(len(f.files))]
        return cls(list(zip(p[::2], p[1::2])))


def losses(model: Perceptron, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed cross entropy, rows that are right at one half, rows."""
    p = model.score(x)
    return np.array([-np.log(np.where(y > 0.5, p, 1 - p).clip(1e-44)).sum(), (np.round(p) == y).sum(), len(y)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(ids: np.ndarray, *seeds: int) -> np.ndarray:
    """A 64-bit number for each id, by the seeds alone: the same wherever a row is."""
    out = ids.astype(np.uint64)
    for s in seeds:
        out = _mixed(out + np.uint64((s * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
    return out


def kept_inputs(ids: np.ndarray, width: int, dropout: float, *seeds: int) -> np.ndarray:
    """Which inputs of each row stay in a step."""
    cells = draws(ids, *seeds)[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(cells) >> np.uint64(11)).astype(float) * 2.0**-53 >= dropout


@dataclass
class Settings:
    """Adam's rate and decay, dropout on the input, and when to stop. ``batches`` is the number of steps an epoch has."""

    epochs: int = 800
    patience: int = 30
    rate: float = 2.5e-6
    decay: float = 1e-5
    dropout: float = 0.15
    batches: int = 1
    seed: int = 432


@dataclass
class Run:
    """One training: its parameters, Adam's moments, and the best model so far. All that it needs of the data is sums."""

    number: int
    theta: np.ndarray
    settings: Settings
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)
    best: np.ndarray = field(init=False)
    step: int = 0
    idle: int = 0
    epochs: int = 0
    least: tuple[float, float] = (np.inf, 0.0)
    over: bool = False

    def __post_init__(self) -> None:
        self.first, self.second, self.best = np.zeros_like(self.theta), np.zeros_like(self.theta), self.theta.copy()

    def update(self, gradient: np.ndarray, rows: float) -> None:
        """A step down the mean gradient of a batch; a batch without rows is no step."""
        if not rows:
            return
        s, self.step = self.settings, self.step + 1
        g = gradient / rows + s.decay * self.theta
        self.first += 0.1 * (g - self.first)
        self.second += 0.001 * (g * g - self.second)
        self.theta = self.theta - s.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)

    def judge(self, epochs: int, loss: float, accuracy: float) -> None:
        """The validation after so many epochs: the best model is kept, without gain for ``patience`` epochs it is over."""
        self.epochs = epochs
        if loss < self.least[0]:
            self.best, self.least, self.idle = self.theta.copy(), (loss, accuracy), 0
        else:
            self.idle += 1
        self.over = self.idle >= self.settings.patience or epochs >= self.settings.epochs


def sums(run: int, theta: np.ndarray, sizes: list[int], s: Settings, epoch: int, batch: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray, training: np.ndarray) -> np.ndarray:
    """What rows add to a step: the gradient, its rows, and loss, hits and rows of the validation and of the training."""
    model = Perceptron.of(sizes, theta)
    out = np.zeros(len(theta) + 7)
    own = training & (draws(ids, s.seed, run, epoch, 1) % np.uint64(s.batches) == batch)
    if own.any():
        kept = kept_inputs(ids[own], x.shape[1], s.dropout, s.seed, run, epoch, 2)
        out[: len(theta)] = model.gradient(x[own] * kept / (1 - s.dropout), y[own])
        out[len(theta)] = own.sum()
    if batch == 0:
        for k, part in enumerate((~training, training)):
            if part.any():
                out[len(theta) + 1 + 3 * k : len(theta) + 4 + 3 * k] = losses(model, x[part], y[part])
    return out


def descend(runs: list[Run], collect) -> None:
    """Train all runs side by side. ``collect`` gives the summed ``sums`` of each run, of all rows, for (run, theta) pairs, an epoch and a batch."""
    settings = runs[0].settings
    for epoch in range(settings.epochs + 1):
        for batch in range(settings.batches):
            active = [r for r in runs if not r.over]
            if not active:
                return
            found = collect([(r.number, r.theta) for r in active], epoch, batch)
            for r in active:
                n, got = len(r.theta), found[r.number]
                if batch == 0 and epoch:
                    loss, hits, rows = got[n + 1 : n + 4] if got[n + 3] else got[n + 4 : n + 7]
                    r.judge(epoch, loss / rows, hits / rows)
                if not r.over:
                    r.update(got[:n], got[n])


def fit(x: np.ndarray, y: np.ndarray, ids: np.ndarray, training: np.ndarray, *, hidden: tuple[int, ...] = HIDDEN, settings: Settings | None = None, runs: int = 1) -> list[Run]:
    """The same training on arrays, in one process."""
    s, sizes = settings or Settings(), [x.shape[1], *hidden, 1]
    own = [Run(k, Perceptron.new(sizes, np.random.default_rng(s.seed + k)).flat(), s) for k in range(runs)]
    descend(own, lambda active, epoch, batch: {k: sums(k, theta, sizes, s, epoch, batch, x, y, ids, training) for k, theta in active})
    return own


def _collect(rows: DataFrame, sizes: list[int], s: Settings):
    """Sums over the executors: each task adds up its rows, each block of numbers is added up in a task of its own, and only
    the total, as long as the model, comes to the driver."""
    sc = rows.sparkSession.sparkContext
    schema = "run int, block int, sums binary"

    def total(active: list[tuple[int, np.ndarray]], epoch: int, batch: int) -> dict[int, np.ndarray]:
        known = sc.broadcast(active)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = {run: np.zeros(len(theta) + 7) for run, theta in known.value}
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, sizes[0])
                    y, ids, training = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                    for run, theta in known.value:
                        out[run] += sums(run, theta, sizes, s, epoch, batch, x, y, ids, training)
            for run, v in out.items():
                cut = [v[i : i + BLOCK].tobytes() for i in range(0, len(v), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["run", "block", "sums"])

        def add(t: pa.Table) -> pa.Table:
            v = sum(np.frombuffer(x.as_py()) for x in t.column("sums"))
            return pa.table({"run": t.column("run")[:1], "block": t.column("block")[:1], "sums": pa.array([v.tobytes()], pa.binary())})

        got = rows.mapInArrow(partial, schema).groupBy("run", "block").applyInArrow(add, schema).collect()
        known.unpersist()
        return {run: np.concatenate([np.frombuffer(r.sums) for r in sorted((r for r in got if r.run == run), key=lambda r: r.block)]) for run, _ in active}

    return total


def train(train_rows: DataFrame, val_rows: DataFrame, key: str, *, runs: int = 1, hidden: tuple[int, ...] = HIDDEN, **options) -> DataFrame:
    """A row a run: its model, the epochs run, validation loss and accuracy (of the training rows where there are none to validate on).

    Every step sums the gradients of its batch where the rows are, so all rows take part and none comes to the driver; runs, which differ in
    their seed, go side by side in the same jobs. Batches and dropout are drawn by each row's key: the result does not depend on how
    rows are dealt, but for rounding. Rows without label or features, or as wide as few others, take no part; without rows there is no model.
    """
    spark, s = train_rows.sparkSession, Settings(**options)
    part = lambda d, flag: d.select(F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"), F.xxhash64(key).alias("id"), F.lit(flag).alias("training"))
    path = work_folder(spark, "training")
    part(train_rows, True).unionByName(part(val_rows, False)).filter("y is not null and features is not null and size(features) > 0").write.parquet(path)
    found = spark.read.parquet(path)
    widths = found.filter("training").groupBy(F.size("features").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], RUN)
    rows = found.filter(F.size("features") == widths.w).persist(StorageLevel.MEMORY_AND_DISK)  # an executor's rows are read again where it is lost
    sizes = [widths.w, *hidden, 1]
    own = [Run(k, Perceptron.new(sizes, np.random.default_rng(s.seed + k)).flat(), s) for k in range(runs)]
    descend(own, _collect(rows, sizes, s))
    rows.unpersist()
    return spark.createDataFrame([(r.number, Perceptron.of(sizes, r.best).to_bytes(), r.epochs, float(r.least[0]), float(r.least[1])) for r in own], RUN)


def predict(models: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``features``) with run and score, once for each run of ``models``."""
    known = rows.sparkSession.sparkContext.broadcast([(r.run, bytes(r.model)) for r in models.select("run", "model").collect()])  # a row a run
    schema = type(rows.schema)([*rows.schema.fields]).add("run", "integer").add("score", "double")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(run, Perceptron.from_bytes(raw)) for run, raw in known.value]
        for b in batches:
            x = np.array(b["features"].tolist(), float) if len(b) else None
            for run, model in own:
                yield b.assign(run=np.int32(run), score=model.score(x) if len(b) else [])

    return rows.mapInPandas(each, schema)


def largest_fit(fits, low: int = 0, high: int = 8192) -> int:
    """The largest size from ``low`` on and below ``high`` that fits, by bisection; ``fits`` must not hold again once it has failed, ``low`` is taken to fit."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def leave_out(rows: DataFrame, split: str, trait: Column, value: object) -> DataFrame:
    """Without a factor's value in training and validation; the test rows stay."""
    return rows.filter((F.col(split) == "test") | ~trait.eqNullSafe(F.lit(value)))


def by_length(rows: DataFrame, prompt: Column, last: Column, border: int = 3112) -> DataFrame:
    """``bucket``: long prompts, short ones with their answer, and what is in neither (null)."""
    return rows.withColumn("bucket", F.when(F.length(prompt) >= border, "long").when(F.length(prompt) + F.length(last) < border, "short"))
