"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards its mean variance; a document's score comes from the
difference of the classes' Gaussian log-densities, whose Mahalanobis terms use the cached Cholesky factors. Shares of few words
scatter, so a text's statistics are first drawn towards those of ordinary prose, the mean over the words of the good training texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Names of the statistics, in the order of the vectors.
FEATURES = (
    "log_words", "word_length", "distinct_words", "same_as_previous", "distinct_bigrams", "upper", "digits",
    "sentence_marks", "exclamations", "symbols", "bars", "blanks", "distinct_lines", "line_words", "capitalised",
)
WIDTH = len(FEATURES)

#: Words of ordinary prose that a text's statistics are drawn towards it by.
SHORT = 20

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "sentence_marks": b".,;:?",
    "exclamations": b"!",
    "symbols": b"#$%&*@^~<>{}[]\\+=_",
    "bars": b"|",
    "blanks": b" \t\r\x0b\x0c\n",
}


def _lut() -> np.ndarray:
    table = np.zeros((len(_CLASSES), 256))
    for i, members in enumerate(_CLASSES.values()):
        table[i, list(members)] = 1
    return table


LUT = _lut()


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text: shares as arcsines of their roots, counts as logarithms; all 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(WIDTH)
    n = len(words)
    counts = LUT @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = dict(zip(_CLASSES, counts / len(data)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    half = lambda share: float(np.arcsin(np.sqrt(min(max(share, 0.0), 1.0))))
    values = {
        "log_words": np.log1p(n),
        "word_length": np.log(sum(map(len, words)) / n),
        # Heaps: distinct words of ordinary prose grow as a power of the length, so the exponent is nearly free of it
        "distinct_words": np.log(len(set(words))) / np.log(n) if n > 1 else 1.0,
        "same_as_previous": half(same / (n - 1)) if n > 1 else 0.0,
        "distinct_bigrams": np.log(len(set(zip(words, words[1:])))) / np.log(n - 1) if n > 2 else 1.0,
        **{k: half(v) for k, v in shares.items()},
        "distinct_lines": half(len(set(lines)) / len(lines)),
        "line_words": np.log1p(n / len(lines)),
        "capitalised": half(sum(65 <= w[0] <= 90 for w in words) / n),
    }
    return np.array([values[k] for k in FEATURES])


def drawn(x: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Rows of statistics, each drawn towards prose as by SHORT more words of it; the number of words stays."""
    n = np.expm1(x[:, :1])
    out = (n * x + SHORT * prose) / (n + SHORT)
    out[:, 0] = x[:, 0]
    return out


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn(name, column(F.col("text")))


@dataclass
class Discriminant:
    """``prior``: share of label 1; ``prose``: statistics of ordinary prose. Per class: mean, inverse Cholesky factor, log-determinant; None if it had no rows."""

    prior: float
    prose: np.ndarray
    scale: np.ndarray
    classes: tuple

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes[0] is None or self.classes[1] is None:
            return np.full(len(x), self.prior)
        x, logs = drawn(x, self.prose), []
        for (mean, inverse, logdet), weight in zip(self.classes, (1 - self.prior, self.prior)):
            z = (x / self.scale - mean) @ inverse.T
            logs.append(np.log(weight) - 0.5 * (np.einsum("ij,ij->i", z, z) + logdet))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _matrix(batch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _added(rows: DataFrame, width: int, sums) -> np.ndarray:
    """``sums(statistics, labels)``, two rows of numbers, one for each label, added over all partitions: what reaches the driver has a fixed size."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, width))
        for batch in batches:
            total += sums(_matrix(batch), batch.column(1).to_numpy(zero_copy_only=False))
        label, position = np.divmod(np.arange(2 * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(position), pa.array(total.ravel())], ["label", "position", "value"])

    out = np.zeros((2, width))
    added = rows.mapInArrow(run, "label long, position long, value double").groupBy("label", "position").agg(F.sum("value").alias("value"))
    for label, position, value in added.collect():
        out[label, position] = value
    return out


def fit(rows: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit to all of ``rows(statistics, label)``; labels other than 0 and 1 are ignored, without any label the prior is 0.5.

    Two passes: the statistics of prose, then the classes' sums of statistics, drawn to it, and of their products.
    """
    known = rows.where("label in (0, 1)").select("statistics", F.col("label").cast("int"))

    def of_prose(x, y):
        n = np.expm1(x[:, :1])
        return np.stack([np.concatenate(([n[y == c].sum()], (n * x)[y == c].sum(axis=0))) for c in (0, 1)])

    words = _added(known, 1 + WIDTH, of_prose)
    one = words[1] if words[1, 0] else words.sum(axis=0)
    prose = one[1:] / one[0] if one[0] else np.zeros(WIDTH)

    def of_classes(x, y):
        x = drawn(x, prose)
        return np.stack([np.concatenate(([np.count_nonzero(y == c)], x[y == c].sum(axis=0), (x[y == c].T @ x[y == c]).ravel())) for c in (0, 1)])

    total = _added(known, 1 + WIDTH + WIDTH * WIDTH, of_classes)
    n = total[:, 0]
    if not n.sum():
        return Discriminant(0.5, prose, np.ones(WIDTH), (None, None))
    both = total.sum(axis=0) / n.sum()
    variance = both[1 + WIDTH :].reshape(WIDTH, WIDTH).diagonal() - both[1 : 1 + WIDTH] ** 2
    scale = np.where(variance > 1e-12, np.sqrt(np.maximum(variance, 1e-12)), 1.0)
    classes = []
    for c in (0, 1):
        if not n[c]:
            classes.append(None)
            continue
        mean = total[c, 1 : 1 + WIDTH] / n[c] / scale
        cov = total[c, 1 + WIDTH :].reshape(WIDTH, WIDTH) / n[c] / np.outer(scale, scale) - np.outer(mean, mean)
        level = max(cov.trace() / WIDTH, 1e-3)
        cov = (1 - shrinkage) * cov + shrinkage * level * np.eye(WIDTH)
        factor = np.linalg.cholesky(cov)
        classes.append((mean, np.linalg.inv(factor), 2 * np.log(factor.diagonal()).sum()))
    return Discriminant(float(n[1] / n.sum()), prose, scale, tuple(classes))


def held_out(doc_id):
    """Column: whether crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, accept: float = 0.7, shrinkage: float = 0.1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of docs.

    Learns from the labels of ids that are not held out, all of them. Null, empty and blank texts have the
    statistics of no words and are scored like any other. Without labels of both classes every score is the share of label 1 (0.5 without any).
    Null labels are ignored; a document labelled twice counts twice, and repeated rows are scored alike. Extra columns
    are ignored.
    """
    stats = saved(with_statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "statistics"), "quality")
    scored = scorer(stats, labels, shrinkage)
    out = stats.select("doc_id", "held_out", scored("statistics").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def scorer(stats: DataFrame, labels: DataFrame, shrinkage: float):
    """The score of statistics as a function of columns, learnt from those rows of ``stats(doc_id, statistics)`` that are labelled and not held out."""
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_fl_id"), F.col("quality").alias("label"))
    known = known.where(~held_out(F.col("_fl_id")))
    train = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_fl_id")).select("statistics", "label")
    model = stats.sparkSession.sparkContext.broadcast(fit(saved(train, "quality-train"), shrinkage))

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(np.stack(rows.to_list())) if len(rows) else [])

    return scored


def accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.7, shrinkage: float = 0.1) -> DataFrame:
    """The rows of docs whose score is at least ``accept``, with all their columns."""
    stats = saved(with_statistics(docs, "_fl_stats"), "quality-docs")
    scored = scorer(stats.select("doc_id", F.col("_fl_stats").alias("statistics")), labels, shrinkage)
    return stats.where(scored("_fl_stats") >= accept).select(*(F.col(f"`{c}`") for c in docs.columns))
