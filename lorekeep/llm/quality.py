"""Quality scores from a regularised quadratic discriminant.

Each document becomes a vector of transformed statistics of its whole text.  The two
classes have Gaussian densities whose covariances are shrunk towards the pooled
covariance and towards a multiple of the identity.  A score is the posterior of label
1: the logistic function of the difference of the log densities, each a
Mahalanobis distance by the class's Cholesky factor, computed once and shipped with the model.

Defined results: a null text counts as empty; an empty text has the statistics 0 and is
scored like any other.  Without labels of both classes every score is the smoothed share of
label 1 (one half without any).  Rows are scored one by one, so repeated rows have equal scores.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import table
from lorekeep.llm.labelled import SAMPLE, held_out, training_rows

CUT = 0.3
#: Share of the pooled covariance and of the identity in a class's covariance.
POOLED, IDENTITY = 0.1, 0.02
OTHER, UPPER, LOWER, DIGIT, SPACE, STOP, SYMBOL = range(7)
_CLASS: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of each code point of the first plane; the last entry stands for all beyond."""
    global _CLASS
    if _CLASS is None:
        out = np.zeros(0x10000, np.uint8)
        for i in range(0x10000):
            c = chr(i)
            if c.isupper():
                out[i] = UPPER
            elif c.isalpha():
                out[i] = LOWER
            elif c.isdigit():
                out[i] = DIGIT
            elif c.isspace():
                out[i] = SPACE
            elif c in ".,;:'\"-()?":
                out[i] = STOP
            elif i < 0x100 and c.isprintable():
                out[i] = SYMBOL
        _CLASS = out
    return _CLASS


STATISTICS = 20


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(char_classes()[np.minimum(points, 0xFFFF)], minlength=7).astype(float)
    size, letters = float(len(points)), n[UPPER] + n[LOWER]
    words = text.split()
    count = float(len(words))
    lines = [x for x in text.split("\n") if x]
    out[0] = np.log1p(count)
    out[1] = np.sqrt(n[UPPER] / max(letters, 1.0))
    out[2] = np.sqrt(n[SYMBOL] / size)
    out[3] = np.sqrt(n[DIGIT] / size)
    out[4] = np.sqrt(n[STOP] / size)
    out[5] = np.sqrt(n[OTHER] / size)
    out[6] = np.sqrt(text.count("!") / size)
    out[7] = np.sqrt(text.count("|") / size)
    if words:
        seen = Counter(words)
        length = np.fromiter(map(len, words), float, len(words))
        out[8] = np.log1p(length.mean())
        out[9] = np.log1p(length.std())
        out[10] = np.log(len(seen) + 1.0) / np.log(count + 1.0)
        out[11] = np.sqrt(max(seen.values()) / count)
        out[12] = np.sqrt(sum(map(operator.eq, words, words[1:])) / count)
        out[13] = np.sqrt(1.0 - len(set(zip(words, words[1:], strict=False))) / max(count - 1.0, 1.0)) if len(words) > 1 else 0.0
        out[14] = np.sqrt(sum(k for w, k in seen.items() if len(w) <= 3) / count)
        out[15] = np.sqrt(sum(k for w, k in seen.items() if not w[-1].isalnum()) / count)
        out[16] = np.sqrt(sum(k for w, k in seen.items() if len(w) > 1 and w.isupper()) / count)
        # repetition net of what a text of this length repeats by chance
        out[17] = np.log1p(count / len(seen))
    if lines:
        out[18] = np.sqrt(1.0 - len(set(lines)) / len(lines))
        out[19] = np.log1p(count / len(lines))
    return out


@dataclass
class Model:
    """Means, inverted Cholesky factors and constants of both classes, or a constant score."""

    constant: float | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = [self.offsets[k] - 0.5 * np.square((z - self.means[k]) @ self.factors[k].T).sum(axis=1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700.0, 700.0)))


def fit(x: np.ndarray, label: np.ndarray, pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """The discriminant of a sample of statistics and labels."""
    if not (label == 0).sum() or not (label == 1).sum():
        return Model(constant=float((label.sum() + 1.0) / (len(label) + 2.0)))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, p = (x - centre) / scale, x.shape[1]
    means = np.stack([z[label == k].mean(axis=0) for k in (0, 1)])
    apart = z - means[label]
    common = apart.T @ apart / len(z)
    factors, offsets = [], []
    for k in (0, 1):
        own = apart[label == k]
        cov = (1.0 - pooled) * (own.T @ own / len(own)) + pooled * common
        cov = (1.0 - identity) * cov + identity * max(np.trace(cov) / p, 1e-9) * np.eye(p)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log((label == k).mean()) - np.log(np.diag(lower)).sum()))
    return Model(centre=centre, scale=scale, means=means, factors=np.stack(factors), offsets=np.array(offsets))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows; only their statistics reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    rows = training_rows(docs, labels, "quality", sample).select("label", "text").mapInArrow(run, "label int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.empty((0, STATISTICS))
    order = np.lexsort([*x.T, rows["label"].to_numpy()])  # the same sums whatever the tasks' order
    return fit(x[order], rows["label"].to_numpy(dtype=int)[order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1."""
    docs = docs.drop("score")
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.stack([statistics(t.as_py()) for t in batch.column(text)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.mapInArrow(run, schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return score(docs, train(docs, labels)).where(F.col("score") >= CUT).select(*docs.columns)
