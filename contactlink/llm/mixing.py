"""Mixing documents to target weights of domains they belong to softly.

A classifier trained on a labelled table gives every document a distribution over domains. Rates, one for each document
and not negative, are then fitted by least squares so that the expected tokens of each domain (rate x tokens x
posterior, over all documents) match the targets. The gradient of a document depends on the rest only through the
domains' totals, so an accelerated projected-gradient step is one aggregation over a narrow table, and a document's
rate follows from its posterior and the totals' residuals of all steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.llm import linear
from contactlink.llm.hashing import Words
from contactlink.llm.linear import Linear
from contactlink.llm.piece_table import ROOM, byte_table
from contactlink.llm.tables import bounded_sample, bytes_of, exact
from contactlink.operators.storage import materialize

#: Most labelled rows that train the domain classifier, chosen by a hash of their id.
TRAINING_ROWS = 6_000
#: Steps end when all totals are within ``CLOSE`` of the budget; after ``STEPS``, or ``PATIENCE`` steps that bring
#: nothing, targets count as out of reach.
STEPS, CLOSE, PATIENCE = 400, 1e-4, 60
#: How far over 1 the rates of ``fit_once`` aim: the more, the nearer its budget is to the largest.
REACH = 8.0
SLICE_BYTES = 4 << 20

#: Domains of the ``labels`` table and the weights asked for.
WEIGHTS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}
OWN = ["n_tokens", "posterior", "rate", "copies"]


def label_domain() -> Column:
    """A labelled row's domain."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str, text_col: str, rows: int) -> list[Linear]:
    """One model against the rest for each domain; none if no labelled document is among ``docs``."""
    marks = [(domain == d).cast("int").alias(f"m{i}") for i, d in enumerate(domains)]
    sample = bounded_sample(labels.select(exact(id_col).alias("_id"), *marks).dropna(), "_id", rows)  # bounded, so broadcast
    joined = docs.select(exact(id_col).alias("_id"), exact(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    ids, features, ys = linear.sampled_features(joined, "_id", "_text", [f"m{i}" for i in range(len(domains))], distinct=False)
    return [Linear(mean=True).fit(features, y) for y in ys.values()] if len(ids) else []


def posteriors(df: DataFrame, models: list[Linear], domains: list[str], text_col: str, keep: list[str], tokenizer: str | None = None,
        room: int = ROOM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The columns of ``keep`` with ``n_tokens`` and ``posterior`` over the domains. Tokens are those of the byte-level BPE
    file ``tokenizer``, or words without one. Without models all domains are equally likely. A task holds about ``room`` pieces of
    text, and works on ``slice_bytes`` of it at a time."""
    flat = df.select(*(exact(c).alias(f"c{i}") for i, c in enumerate(keep)), exact(text_col).cast("string").alias("_text"))
    at = len(keep)
    schema = T.StructType([*flat.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in linear.in_slices(batch, at, slice_bytes):
                text = part.column(at)
                counts = byte_table(tokenizer, room).counts(text) if tokenizer else Words(*bytes_of(text)).counts
                if models:
                    rows = linear.rows_of(text, distinct=False)
                    found = np.column_stack([m.predict(rows) for m in models]) + 1e-6
                else:
                    found = np.ones((part.num_rows, len(domains)))
                found /= found.sum(1, keepdims=True)
                flat_values = pa.array(found.ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(domains), pa.int32()), flat_values)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), lists], names=schema.names)

    return flat.mapInArrow(add, schema).toDF(*keep, "n_tokens", "posterior")


class Fit:
    """The steps so far: residuals of the domains' totals, by which any document's rate can be told."""

    def __init__(self, start: float, rate: float, residuals: list[np.ndarray]):
        self.start, self.rate, self.residuals = start, rate, residuals
        self.momenta: list[float] = []
        self.most = np.inf

    def points(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all steps, and the point at which the next gradient is taken (Nesterov)."""
        now = before = np.full(len(posterior), self.start)
        ahead = now
        for residual, momentum in zip(self.residuals, self.momenta):
            before, now = now, np.maximum(0.0, ahead - self.rate * (posterior @ residual))
            ahead = now + momentum * (now - before)
        return np.minimum(now, self.most), ahead


def _totals(table: DataFrame, fit: Fit, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain, at the rates and at the point ahead."""
    schema = ", ".join(f"r{i} double, a{i} double" for i in range(k))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = np.asarray(batch.column(1).flatten()).reshape(-1, k)
            now, ahead = fit.points(posterior)
            tokens = batch.column(0).to_numpy()
            r, a = (tokens * now) @ posterior, (tokens * ahead) @ posterior
            yield pa.RecordBatch.from_arrays([pa.array([x]) for pair in zip(r, a) for x in pair], names=[f"{s}{i}" for i in range(k) for s in "ra"])

    found = table.select("n_tokens", "posterior").mapInArrow(sums, schema).agg(*(F.sum(f"{s}{i}").alias(f"{s}{i}") for i in range(k) for s in "ra")).first()
    return np.array([found[f"r{i}"] or 0.0 for i in range(k)]), np.array([found[f"a{i}"] or 0.0 for i in range(k)])


def fit_rates(table: DataFrame, weights: np.ndarray, budget: float | None = None, steps: int = STEPS) -> tuple[Fit, np.ndarray, np.ndarray]:
    """Fit rates to ``n_tokens, posterior``; also the totals reached and the targets.

    ``budget`` is the tokens asked for in all, by default as many as there are: rates are then 1 on average, and only what
    a domain has over its target is thinned out. Targets that are not met are told by a warning. The steps use the metric in which a document weighs as many times as it has tokens; there the fit is the one nearest
    to equal rates, and long documents are not preferred.
    """
    k = len(weights)
    one = [F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]
    two = [F.sum(F.col("n_tokens") * F.col("posterior")[i] * F.col("posterior")[j]).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]
    row = table.agg(*one, *two).first()
    natural = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    total = natural.sum()
    if not total:
        return Fit(1.0, 0.0, []), natural, natural
    second = np.array([[row[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    wanted = weights / weights.sum()
    budget = total if budget is None else budget
    targets = wanted * budget
    # Squares are measured in the metric of the posteriors' second moments, so rare domains converge as fast as common ones.
    metric = np.linalg.pinv(second, rcond=1e-9, hermitian=True)
    fit = Fit(budget / total, 1.0, [])
    reached, best, missed, run, idle = natural, np.inf, np.inf, 0, 0
    while True:
        reached, ahead = _totals(table, fit, k)
        miss = float(np.abs(reached - targets).max())
        if miss <= CLOSE * budget:
            return fit, reached, targets
        idle = 0 if miss < 0.99 * best else idle + 1
        best = min(best, miss)
        if len(fit.residuals) == steps or idle == PATIENCE:
            warnings.warn(f"target tokens {targets.tolist()} are not met; reached {reached.tolist()}", stacklevel=2)
            return fit, reached, targets
        far = float((reached - targets) @ metric @ (reached - targets))
        run = 0 if far > missed else run + 1  # the momentum starts anew where it has gone too far
        missed = far
        fit.residuals.append(metric @ (ahead - targets) / total)
        fit.momenta.append(run / (run + 3))


class Once:
    """Rates of documents kept once at most: they fall with the posterior's product with ``slope``."""

    def __init__(self, slope: np.ndarray, reach: float = REACH):
        self.slope, self.reach = slope, reach

    def aims(self, posterior: np.ndarray) -> np.ndarray:
        return self.reach - posterior @ self.slope

    def points(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now = np.clip(self.aims(posterior), 0.0, 1.0)
        return now, now


def _moments(table: DataFrame, trials: list[Once], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each trial: the dual value (without its constant), tokens of each domain, and second moments of the posteriors
    of documents with a rate between 0 and 1. One aggregation."""
    width = 1 + k + k * k
    schema = ", ".join(f"m{i} double" for i in range(width * len(trials)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = np.asarray(batch.column(1).flatten()).reshape(-1, k)
            tokens = batch.column(0).to_numpy().astype(float)
            found: list[float] = []
            for trial in trials:
                aim, rate = trial.aims(posterior), trial.points(posterior)[0]
                inner = posterior[(aim > 0) & (aim < 1)]
                weight = tokens[(aim > 0) & (aim < 1)]
                found += [tokens @ (rate * aim - rate**2 / 2), *((tokens * rate) @ posterior), *((inner * weight[:, None]).T @ inner).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in found], names=[f"m{i}" for i in range(len(found))])

    row = table.select("n_tokens", "posterior").mapInArrow(sums, schema).agg(*(F.sum(f"m{i}").alias(f"m{i}") for i in range(width * len(trials)))).first()
    flat = np.array([x or 0.0 for x in row]).reshape(len(trials), width)
    return [(f[0], f[1 : k + 1], f[k + 1 :].reshape(k, k)) for f in flat]


def fit_once(table: DataFrame, weights: np.ndarray, steps: int = STEPS) -> tuple[Fit | Once, np.ndarray, np.ndarray]:
    """Rates between 0 and 1 for ``n_tokens, posterior`` whose totals have the shares of ``weights``; also the totals
    reached and the targets, which are the shares of what is reached.

    Of all such rates these are the nearest, in the metric of tokens, to ``REACH`` for every document: as much is kept as
    the shares allow, and no share is bought by thinning out more than it takes. They are found by Newton's method on the
    dual, which has one unknown less than there are domains; a step tries several lengths in one aggregation. Shares that
    no rates reach (a domain without tokens) leave the rates of ``fit_rates``, capped at 1, and a warning.
    """
    k = len(weights)
    wanted = weights / weights.sum()
    basis = np.linalg.svd(wanted[None, :])[2][1:].T  # orthogonal to the weights: what they leave free
    slope = np.zeros(k)
    value, reached, second = _moments(table, [Once(slope)], k)[0]
    total = reached.sum()
    if not total:
        return Once(slope), reached, reached
    for _ in range(steps):
        if reached.sum() > 0 and np.abs(reached / reached.sum() - wanted).max() <= CLOSE:
            return Once(slope), reached, wanted * reached.sum()
        gradient = basis.T @ reached / total  # of the dual's descent: the value falls along it
        curve = basis.T @ second @ basis / total
        best = None
        for damping in (1e-9, 1e-3):
            newton = np.linalg.solve(curve + damping * np.eye(k - 1), gradient) if k > 1 else gradient
            way = basis @ newton
            way = way * min(1.0, REACH * 4 / max(np.abs(way).max(), 1e-12))
            trials = [slope + way * 0.5**i for i in range(12)]
            found = _moments(table, [Once(t) for t in trials], k)
            at = int(np.argmin([f[0] for f in found]))
            if found[at][0] < value:
                best = at
                break
        if best is None:
            break
        slope, (value, reached, second) = trials[best], found[best]
    if reached.sum() > 0 and np.abs(reached / reached.sum() - wanted).max() <= CLOSE:
        return Once(slope), reached, wanted * reached.sum()
    fit, _, _ = fit_rates(table, weights)
    fit.most = 1.0
    reached, _ = _totals(table, fit, k)
    warnings.warn(f"target weights {wanted.tolist()} cannot be met by keeping documents once; reached tokens {reached.tolist()}", stacklevel=2)
    return fit, reached, wanted * reached.sum()


def mix(df: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", keep: list[str] | None = None, rows: int = TRAINING_ROWS, budget: float | None = None,
        once: bool = False, tokenizer: str | None = None, room: int = ROOM, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every row of ``df`` with ``n_tokens``, ``posterior`` (in the order of ``weights``), ``rate`` and ``copies``.

    ``copies`` rounds the rate by a hash of the id, so that its expectation is the rate; 0 means the document is left
    out. ``keep`` names the columns to carry, all by default. A null or empty text has no tokens, and the rate of its
    posterior. Rows that repeat an id get the same rate. Columns with the new names are replaced. With ``once`` rates are 1
    at most and the budget is the largest that the weights allow. ``tokenizer`` says what a token is, ``room`` and ``slice_bytes`` what a task holds; see ``posteriors``.
    """
    if once and budget is not None:
        raise ValueError("a mix of documents kept once finds its budget itself")
    weights, domain = weights or WEIGHTS, label_domain() if domain is None else domain
    domains = list(weights)
    keep = [c for c in keep or df.columns if c.lower() not in OWN]
    models = train(df, labels, domain, domains, id_col, text_col, rows)
    table = materialize(posteriors(df, models, domains, text_col, keep, tokenizer, room, slice_bytes).withColumnsRenamed({c: f"c{i}" for i, c in enumerate(keep)}), "mixing")
    asked = np.array([weights[d] for d in domains])
    fit, _, _ = fit_once(table, asked) if once else fit_rates(table, asked, budget)
    at = len(keep) + 1
    schema = T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = np.asarray(batch.column(at).flatten()).reshape(-1, len(domains))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fit.points(posterior)[0])], names=schema.names)

    rated = table.mapInArrow(rates, schema).toDF(*keep, "n_tokens", "posterior", "rate")
    chance = F.pmod(F.xxhash64(exact(id_col), F.lit(8)), F.lit(1 << 30)) / (1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
