"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of fixed length. Bytes are embedded, filters of several widths run over each window, the
largest response of each filter is kept, and a softmax over these gives the language. A text's distribution is the mean
over its windows by length. Training is plain back-propagation: because of the max only one place per window and filter
gets a gradient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlink.llm.linear import in_slices
from contactlink.llm.tables import bytes_of, exact

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Most training documents for each language and in all, chosen by a hash of their id, and windows of each.
PER_LANGUAGE, TRAINING_ROWS, WINDOWS_EACH = 1_000, 8_000, 4
EPOCHS, BATCH, RATE = 4, 64, 3e-3
AT_ONCE = 128
UNKNOWN = "und"


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, filled up with zero bytes; how many bytes each has, and where each text begins."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    begins = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begins[-1]) * size, np.uint8)
    out[np.arange(len(data)) + np.repeat(begins[:-1] * size - offsets[:-1], lengths)] = data
    used = np.full(int(begins[-1]), size, np.int64)
    last = begins[1:][counts > 0] - 1
    used[last] = (lengths - (counts - 1) * size)[counts > 0]
    return out.reshape(-1, size), used, begins


class ByteNet:
    """Embedding, filters of all widths, and the layer before the softmax."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        features = FILTERS * len(WIDTHS)
        self.params = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
            **{f"w{w}": rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS},
            **{f"b{w}": np.zeros(FILTERS) for w in WIDTHS},
            "out": rng.normal(0, features**-0.5, (features, len(languages))),
            "bias": np.zeros(len(languages)),
        }
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _pooled(self, windows: np.ndarray, places: bool = False):
        p = self.params
        embedded = p["embed"][windows]
        n, size, e = embedded.shape
        flat = embedded.reshape(n, size * e)
        pooled, at = [], []
        for w in WIDTHS:
            steps = size - w + 1
            patches = np.lib.stride_tricks.as_strided(flat, (n, steps, w * e), (flat.strides[0], e * 4, 4))
            response = np.ascontiguousarray(patches).reshape(n * steps, w * e) @ p[f"w{w}"]
            response = response.reshape(n, steps, FILTERS)
            if places:
                best = response.argmax(1)
                at.append(best)
                top = np.take_along_axis(response, best[:, None, :], 1)[:, 0, :]
            else:
                top = response.max(1)
            pooled.append(top + p[f"b{w}"])
        return np.concatenate(pooled, 1), at, flat

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.params["out"] + self.params["bias"]
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Distribution over the languages for each window."""
        parts = [self._softmax(self._pooled(windows[i : i + AT_ONCE])[0]) for i in range(0, len(windows), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, y: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        pooled, at, flat = self._pooled(windows, places=True)
        error = self._softmax(pooled)
        error[np.arange(len(y)), y] -= 1
        error *= (weights / weights.sum())[:, None]
        out = {"out": np.maximum(pooled, 0).T @ error, "bias": error.sum(0)}
        back = (error @ p["out"].T) * (pooled > 0)
        embed = np.zeros_like(p["embed"])
        for i, w in enumerate(WIDTHS):
            mine = back[:, i * FILTERS : (i + 1) * FILTERS]
            reach = at[i][:, :, None] + np.arange(w)  # window, filter, byte of the chosen patch
            chosen = windows[np.arange(len(windows))[:, None, None], reach]
            patches = p["embed"][chosen].reshape(len(windows), FILTERS, w * EMBEDDING)
            out[f"w{w}"] = np.einsum("nf,nfk->kf", mine, patches)
            out[f"b{w}"] = mine.sum(0)
            down = (mine[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, EMBEDDING)
            np.add.at(embed, chosen.ravel(), down)
        out["embed"] = embed
        return out

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> ByteNet:
        """Adam over shuffled batches. Languages weigh the same, and half of the windows are shown cut short, as the
        windows of short texts are."""
        rng = np.random.default_rng(seed)
        balance = (len(y) / np.maximum(np.bincount(y, minlength=len(self.languages)), 1))[y].astype(np.float32)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, total = 0, epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick = order[i : i + BATCH]
                batch = windows[pick].copy()
                keep = np.where(rng.random(len(pick)) < 0.5, windows.shape[1], rng.integers(8, windows.shape[1], len(pick)))
                batch[np.arange(windows.shape[1]) >= keep[:, None]] = 0
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                for k, g in self.gradients(batch, y[pick], balance[pick]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.params[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> ByteNet | None:
    """Train on a bounded sample of the labelled documents; of each, windows at even distances. None without any."""
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(6)), "id")
    ids = labelled.select(exact(id_col).alias("id"), exact(lang_col).cast("string").alias("lang")).dropna()
    ids = ids.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= PER_LANGUAGE).orderBy("n", "lang", "id").limit(TRAINING_ROWS)
    # The sample's ids are bounded, so they can be broadcast; texts are cut to their windows before they leave the executors.
    chosen = labelled.select(exact(id_col).alias("id"), exact(text_col).cast("string").alias("text"), exact(lang_col).cast("string").alias("lang"))
    chosen = chosen.join(F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 1, 4 << 20):
                windows, _, begins = windows_of(*bytes_of(batch.column(1)))
                picks = [np.unique(np.linspace(a, b - 1, WINDOWS_EACH).astype(int)) if b > a else [] for a, b in zip(begins, begins[1:])]
                owner = np.repeat(np.arange(len(picks)), [len(x) for x in picks])
                rows = [windows[i].tobytes() for x in picks for i in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(rows, pa.binary())], names=["id", "lang", "window"])

    got = chosen.select("id", "text", "lang").mapInArrow(cut, _cut_schema(chosen)).orderBy("id", "lang", "window").toArrow()
    if not got.num_rows:
        return None
    windows = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    languages = sorted(set(got["lang"].to_pylist()))
    y = np.array([languages.index(x) for x in got["lang"].to_pylist()])
    return ByteNet(languages).fit(windows, y)


def _cut_schema(df: DataFrame):
    return df.select("id", "lang", F.lit(b"").alias("window")).schema


def identify(df: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all by default) with ``lang_pred`` and ``score``. Only the text is looked at, all of it.

    A text that is null or has no letter, and every text if there is no ``net``, is ``und`` with score 0. Columns with
    the new names are replaced, repeated rows kept. No shuffle.
    """
    keep = [c for c in keep or df.columns if c.lower() not in ("lang_pred", "score")]
    letter = F.coalesce(exact(text_col).rlike("\\p{L}"), F.lit(False))
    text = F.when(letter, exact(text_col))
    at = len(keep)
    flat = df.select(*(exact(c).alias(f"c{i}") for i, c in enumerate(keep)), text.alias("text"))
    schema = flat.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).drop("text").schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, at, 2 << 20):
                found, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                windows, used, begins = windows_of(*bytes_of(batch.column(at)))
                if net is not None and len(windows):
                    weighed = net.predict(windows) * used[:, None]
                    there = np.flatnonzero(np.diff(begins))
                    mean = np.add.reduceat(weighed, begins[there]) / np.add.reduceat(used, begins[there])[:, None]
                    for i, k in zip(there, mean.argmax(1)):
                        found[i] = net.languages[k]
                    score[there] = np.clip(mean.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.string()), pa.array(score)], names=schema.names)

    return flat.mapInArrow(add, schema).toDF(*keep, "lang_pred", "score")
