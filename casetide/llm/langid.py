"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes (ASCII letters folded) are cut into windows of ``WINDOW`` bytes, all of them, the last one
padded with zeros. Each byte has a small embedding; filters of several widths slide over a window, pass a
rectifier and are pooled by their maximum; a softmax layer gives the languages. A text's scores are the mean of its
windows' probabilities.

Training takes a bounded sample of the labelled rows: about ``PER_LANGUAGE`` documents for each language, chosen
by a hash of the id, with ``PIECES`` windows spread evenly over each. Both bounds are parameters. Rows whose
crc32(id as text) mod ``FOLDS`` is ``HELD_OUT`` are never learned from, nor are rows without an id. Label, source
and id are no inputs of a prediction.

A null text or one without letters gets ``und`` and score 0; so does every text when there is nothing to learn
from. Prediction is a map without a shuffle, and the model has a fixed size of some ten thousand numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_bytes

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4, 5)
PER_LANGUAGE, PIECES, EPOCHS, BATCH, RATE = 400, 6, 6, 64, 0.004
FOLDS, HELD_OUT = 4, 2
#: Score below which a text's language counts as unknown.
LEAST_SCORE = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]


def _mask() -> np.ndarray:
    """A filter narrower than the widest has zeros in the rows it doesn't see."""
    rows = np.arange(max(WIDTHS) * EMBEDDING)[:, None]
    return (rows < np.repeat(WIDTHS, FILTERS)[None, :] * EMBEDDING).astype(np.float32)


def _columns(net: Network, windows: np.ndarray) -> np.ndarray:
    """Each position's neighbourhood of embeddings, as the rows of a matrix."""
    n, widest = len(windows), max(WIDTHS)
    embedded = net.embedding[windows].reshape(n, WINDOW * EMBEDDING)
    view = np.lib.stride_tricks.sliding_window_view(embedded, widest * EMBEDDING, axis=1)[:, ::EMBEDDING]
    return view.reshape(n * view.shape[1], widest * EMBEDDING)


def _pooled(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = _columns(net, windows)
    values = (columns @ net.filters).reshape(len(windows), -1, len(net.bias))
    return columns, values


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Softmax over the languages of each window."""
    out = np.empty((len(windows), len(net.languages)), np.float32)
    for i in range(0, len(windows), 128):
        values = _pooled(net, windows[i : i + 128])[1].max(axis=1)
        out[i : i + 128] = _softmax(np.maximum(values + net.bias, 0) @ net.out + net.out_bias)
    return out


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the cross-entropy of windows; the gradient of the pooled maximum goes to its position only."""
    rng = np.random.default_rng(seed)
    wide, count, n_out = max(WIDTHS) * EMBEDDING, FILTERS * len(WIDTHS), len(languages)
    mask = _mask()
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, normal(256, EMBEDDING, scale=0.5), normal(wide, count, scale=0.3) * mask, np.zeros(count, np.float32), normal(count, n_out, scale=0.2), np.zeros(n_out, np.float32))
    net.embedding[0] = 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    share = np.bincount(labels, minlength=n_out)
    weight = (len(labels) / (n_out * np.maximum(share, 1))).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            x, y = windows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
            columns, values = _pooled(net, x)
            at = values.argmax(axis=1)
            pooled = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + net.bias
            active = np.maximum(pooled, 0)
            delta = _softmax(active @ net.out + net.out_bias)
            delta[np.arange(len(y)), y] -= 1
            delta *= weight[y][:, None] / len(y)
            back = (delta @ net.out.T) * (pooled > 0)
            rows = at + np.arange(len(x))[:, None] * values.shape[1]
            seen = columns[rows]  # window, filter, neighbourhood
            d_filters = np.einsum("bf,bfk->kf", back, seen, optimize=True) * mask
            d_seen = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
            byte_at = (at[:, :, None] + np.arange(max(WIDTHS))).reshape(len(x), -1)
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, np.take_along_axis(x, byte_at, axis=1).ravel(), d_seen)
            d_embedding[0] = 0
            step += 1
            for p, g, (m, v) in zip(net.parts(), [d_embedding, d_filters, back.sum(0), active.T @ delta, delta.sum(0)], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the rows of a byte column, and where rows begin among them."""
    lengths = np.diff(at)
    counts = -(-lengths // WINDOW)
    rows = np.concatenate([[0], np.cumsum(counts)])
    windows = np.zeros(int(rows[-1]) * WINDOW, np.uint8)
    shift = np.repeat(rows[:-1] * WINDOW - at[:-1], lengths)
    windows[np.arange(len(data)) + shift] = _FOLD[data]
    return windows.reshape(-1, WINDOW), rows


def fold(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> Network | None:
    """Train on a bounded sample of the labelled rows that are not held out; None where there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id")) != HELD_OUT))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / counts[lang]))).otherwise(share)
    chosen = F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30)
    length = F.length("text")
    piece = [F.substring(F.col("text"), (F.lit(1) + F.floor(length * k / pieces)).cast("int"), F.lit(WINDOW)) for k in range(pieces)]
    sample = rows.where(chosen).select("id", "lang", *[p.alias(f"p{k}") for k, p in enumerate(piece)]).collect()
    texts, labels = [], []
    for row in sorted(sample, key=lambda r: r.id):
        for p in dict.fromkeys(row[2:]):
            if any(c.isalpha() for c in p):
                texts.append(p.encode()[:WINDOW])
                labels.append(languages.index(row.lang))
    if not texts:
        return None
    windows, _ = cut(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return train(windows, np.array(labels), languages)


def _predictor(net: Network | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 100) for whole in batches for i in range(0, whole.num_rows, 100)):
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if net is not None:
                windows, rows = cut(*text_bytes(batch.column(1)))
                chances = probabilities(net, windows)
                for i, letters in enumerate(batch.column(2).to_pylist()):
                    if letters:
                        mean = chances[rows[i] : rows[i + 1]].mean(axis=0, dtype=np.float64)
                        k = int(mean.argmax())
                        names[i], scores[i] = net.languages[k], min(1.0, float(mean[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from the text alone."""
    short_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predictor(net), "id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (see the module)."""
    found = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with letters and a score of ``least`` or more, all columns unchanged.

    The prediction runs as an expression over the text, so no row is matched by its id again and none is shuffled. With
    nothing to learn from, no text is rejected for its score.
    """
    net = fit(docs, id_col, text_col, lang_col)
    if net is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    short_batches(docs.sparkSession)

    def identified(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = []
            for i in range(0, len(text), 100):
                windows, rows = cut(*text_bytes(text.slice(i, 100)))
                chances = probabilities(net, windows)
                parts += [b > a and float(chances[a:b].mean(axis=0, dtype=np.float64).max()) >= least for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.array(parts, pa.bool_())

    known = F.arrow_udf(identified, "boolean")
    return docs.where(F.col(text_col).rlike(r"\p{L}")).where(known(F.col(text_col)))
