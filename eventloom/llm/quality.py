"""Quality: a compression classifier.

Two zstandard dictionaries are built, one from good and one from bad labelled text.
The whole text is cut into segments and each segment is compressed with either
dictionary. The difference of the compressed sizes by their sum, together with the
compressed share of the text, goes through a logistic calibration to a score from 0
to 1. Every part of a long text counts alike, as each segment meets the dictionaries
anew.

Labels are learned from at most ``TRAIN_EACH`` rows a class, chosen by a hash of the
id; a fifth of them is left out of the dictionaries and fits the calibration, at the
true share of the classes. lang, source and id are never inputs. Scoring is a scan:
no shuffle, one fixed-size model sent to the executors.

Defined cases: null and empty texts score as a text without evidence (difference 0);
null labels and labels without a document are not learned from; if a class has no
labels, every score is the share of good labels; repeated rows score alike; empty
tables give empty results; ``score_documents`` passes extra columns through and
replaces columns named score or predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, table
from .toxicity import labelled_sample, trained

#: Bound of the labelled sample that the classifier is fitted on.
TRAIN_EACH = 3000
DICTIONARY_BYTES = 64 * 1024
SEGMENT = 2048
LEVEL = 3
THRESHOLD = 0.3


def segments(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]


def dictionary(texts: list[str | None]) -> bytes:
    """A dictionary of the texts' segments; raw content where they are too few to train one."""
    import zstandard

    samples = [s for t in texts for s in segments(t) if len(s) >= 32]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\x00" * 8


class Model:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = good, bad
        self.weights = np.zeros(4)
        self.centre, self.scale = np.zeros(3), np.ones(3)
        self.constant: float | None = None

    def compressors(self):
        import zstandard

        made = []
        for content in (self.good, self.bad):
            loaded = zstandard.ZstdCompressionDict(content)
            loaded.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=loaded, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def evidence(self, texts, compressors) -> np.ndarray:
        """Per text: (bad size - good size) / their sum, compressed share, share of the better dictionary."""
        good, bad = (c.compress for c in compressors)
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            parts = segments(text)
            if parts:
                size = sum(map(len, parts))
                g, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
                out[i] = (b - g) / (b + g), (b + g) / (2 * size), min(b, g) / size
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        x = (evidence - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:3] + self.weights[3], -30, 30)))


def calibrate(model: Model, evidence: np.ndarray, label: np.ndarray, share: float) -> None:
    """Weighted, slightly ridged logistic regression by Newton's method."""
    model.centre, model.scale = evidence.mean(axis=0), evidence.std(axis=0) + 1e-6
    x = np.column_stack([(evidence - model.centre) / model.scale, np.ones(len(label))])
    weight = np.where(label > 0, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum())) * len(label)
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w


def train(texts: list[str | None], labels: np.ndarray, share: float) -> Model:
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        model = Model(b"\x00" * 8, b"\x00" * 8)
        model.constant = float(min(0.99, max(0.01, share))) if len(labels) else 0.5
        return model
    order = np.random.default_rng(1).permutation(len(labels))
    hold, fit = order[: max(2, len(order) // 5)], order[max(2, len(order) // 5) :]
    if len(np.unique(labels[hold])) < 2 or len(np.unique(labels[fit])) < 2:
        hold = fit = order
    model = Model(dictionary([texts[i] for i in fit if labels[i] > 0]), dictionary([texts[i] for i in fit if labels[i] == 0]))
    calibrate(model, model.evidence([texts[i] for i in hold], model.compressors()), labels[hold], share)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label="quality") -> Model:
    return trained(*labelled_sample(docs, labels, label, id_col, text_col, TRAIN_EACH, TRAIN_EACH), train)


def score_documents(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with score and predicted."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("score", "predicted")]
    at = names.index(text_col)
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        compressors = own.compressors()
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            score = own.scores(np.concatenate([own.evidence([t], compressors) for t in texts] or [np.zeros((0, 3))]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"]
            )

    return df.select(*names).mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
