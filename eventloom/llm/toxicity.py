"""Toxicity: a small convolutional text classifier over hashed word embeddings.

A word's vector is the sum of hashed embeddings of the word and of its first 4, 5,
6 and 8 bytes, so inflected forms share most of it. A bucket belongs to the feature
seen in most training documents and carries that feature's 64-bit hash; any other
feature that falls there counts as unknown (a zero vector), so rare words of a large
corpus cannot pose as known ones. Filters of width 1, 2 and 3 slide over the words
of the whole text, each is max-pooled, and a logistic layer weighs the maxima. All
is trained in numpy by stochastic gradients.

The threshold is calibrated by language on rows kept out of the gradient steps. The
language is guessed from function words of the text itself; the columns lang,
source, id and labels are never inputs.

Labels are learned from at most ``TRAIN_TOXIC`` + ``TRAIN_CLEAN`` rows, chosen by a
hash of the id; the rows' whole texts are used. Scoring is a scan: no shuffle, one
fixed-size model sent to the executors.

Defined cases: null and empty texts score as a text without words; null labels and
labels without a document are not learned from; if a class has no labels, every
score is that of the class prior; repeated rows score alike; empty tables give empty
results; ``score_documents`` passes extra columns through and replaces columns named
score or predicted.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import fold, table

#: Bounds of the labelled sample that the classifier is fitted on.
TRAIN_TOXIC, TRAIN_CLEAN = 2500, 4000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 6, (1, 2, 3)
PREFIXES = (4, 5, 6, 8)
#: Training documents in which a feature must occur.
LEAST_DOCUMENTS = 3
#: Rounds over the fitted rows, and steps of BATCH rows, that training takes at least unless the loss vanishes before.
EPOCHS, LEAST_STEPS, BATCH = 8, 1300, 32
THRESHOLD = 0.5
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as on be by this are from or an".split(),
    "de": "der die das und ist von den mit zu im ein eine nicht für auf dem sich des als auch".split(),
    "fr": "le la les et des est dans une pour que qui sur pas avec du au par plus ce ne".split(),
    "es": "el los las y del que en una por con para es se no al lo como más su pero".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each word: the word and its prefixes, 0 where the word is shorter; row of each word)."""
    data = tb.latin_lower(data)
    starts, ends = tb.letters(data, offsets)
    prefix = tb.prefix_hash(data)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = tb.hashes(prefix, starts, ends)
    for k, n in enumerate(PREFIXES):
        long = ends - starts >= n
        out[long, k + 1] = tb.hashes(prefix, starts[long], starts[long] + n) ^ np.uint64(0xABCD * (n + 1))
    return out, np.searchsorted(offsets, starts, "right") - 1


class Net:
    """Parameters and the forward and backward passes."""

    def __init__(self, tags: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.tags = tags
        self.table = np.where(tags[:, None] != 0, rng.normal(0, 0.05, (len(tags), DIM)), 0).astype(np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32)
        self.bias = np.float32(-2.0)
        self.limits = np.zeros(len(LANGUAGES), np.float32)
        self.constant: float | None = None
        self.votes = np.array([[tb.hash_of(w) for w in FUNCTION_WORDS[k]] for k in FUNCTION_WORDS], np.uint64)

    def slots(self, found: np.ndarray) -> np.ndarray:
        """Bucket of each known feature, 0 for an unknown one (bucket 0 is never owned)."""
        at = (found & np.uint64(len(self.tags) - 1)).astype(np.int64)
        return np.where(self.tags[at] == found, at, 0).astype(np.int32)

    def pooled(self, vectors: np.ndarray, doc: np.ndarray, docs: int):
        """Per document the greatest value of each filter (at least 0) and, where wanted, all values."""
        maxima, values = np.zeros((docs, len(self.out)), np.float32), []
        for k, w in enumerate(WIDTHS):
            n = len(vectors) - w + 1
            if n <= 0:
                values.append(None)
                continue
            z = vectors[:n] @ self.filters[k][0]
            for j in range(1, w):
                z += vectors[j : j + n] @ self.filters[k][j]
            z += self.shift[k]
            inside = doc[:n] == doc[w - 1 :]
            rows = np.flatnonzero(inside)
            values.append((z, rows))
            if len(rows):
                owner = doc[rows]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                top = np.maximum.reduceat(z if len(rows) == n else z[rows], first, axis=0)
                maxima[owner[first], k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
        return maxima, values

    def logits(self, at: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        maxima, _ = self.pooled(self.table[at].sum(axis=1), doc, docs)
        return maxima @ self.out + self.bias

    def language(self, whole: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Index into LANGUAGES by the most function words, 'other' without any."""
        count = np.stack([np.bincount(doc[np.isin(whole, v)], minlength=docs) for v in self.votes])
        return np.where(count.max(axis=0) > 0, count.argmax(axis=0), len(LANGUAGES) - 1)

    def scores(self, found: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(docs, self.constant)
        logit = self.logits(self.slots(found), doc, docs).astype(np.float64) - self.limits[self.language(found[:, 0], doc, docs)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def step(self, at: np.ndarray, doc: np.ndarray, label: np.ndarray, memory: dict, rate: float) -> float:
        docs = len(label)
        vectors = self.table[at].sum(axis=1)
        maxima, values = self.pooled(vectors, doc, docs)
        chance = 1 / (1 + np.exp(-np.clip(maxima @ self.out + self.bias, -30, 30)))
        error = (chance - label).astype(np.float32)
        back = error[:, None] * self.out * (maxima > 0)
        grads = {"out": maxima.T @ error + 1e-3 * self.out, "bias": error.sum()}
        rows_all, grad_all = [], []
        for k, w in enumerate(WIDTHS):
            gf, gs = np.zeros_like(self.filters[k]), np.zeros_like(self.shift[k])
            if values[k] is not None:
                z, rows = values[k]
                owner = doc[rows]
                for f in range(FILTERS):
                    hit = rows[z[rows, f] == maxima[owner, k * FILTERS + f]]
                    who, first = np.unique(doc[hit], return_index=True)
                    hit, g = hit[first], back[who, k * FILTERS + f]
                    gs[f] += g.sum()
                    for j in range(w):
                        gf[j, :, f] += g @ vectors[hit + j]
                        rows_all.append(hit + j)
                        grad_all.append(g[:, None] * self.filters[k][j, :, f])
            grads[f"f{k}"], grads[f"s{k}"] = gf + 1e-3 * self.filters[k], gs
        for name, g in grads.items():
            g = np.asarray(g, np.float32) / docs
            memory[name] = memory.get(name, 1e-4) + g * g
            change = rate * g / np.sqrt(memory[name])
            if name == "out":
                self.out -= change
            elif name == "bias":
                self.bias = np.float32(self.bias - change)
            elif name[0] == "f":
                self.filters[int(name[1:])] -= change
            else:
                self.shift[int(name[1:])] -= change
        if rows_all:
            slots = at[np.concatenate(rows_all)]
            g = np.repeat(np.concatenate(grad_all)[:, None, :], slots.shape[1], axis=1)[slots > 0] / docs
            keys, where = np.unique(slots[slots > 0], return_inverse=True)
            total = np.zeros((len(keys), DIM), np.float32)
            np.add.at(total, where, g)
            total += 1e-4 * self.table[keys] / docs
            seen = memory.setdefault("table", np.full(len(self.table), 1e-6, np.float32))
            seen[keys] += (total * total).mean(axis=1)
            self.table[keys] -= rate * total / np.sqrt(seen[keys])[:, None]
        return float(-np.mean(np.log(np.where(label > 0, chance, 1 - chance) + 1e-7)))


def owners(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which feature owns each bucket: the one in most documents, ties to the smaller hash. Parts hold whole documents."""
    seen, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for found, doc in parts:
        flat = found.ravel()
        who = np.repeat(doc, found.shape[1])
        order = np.lexsort((flat, who))
        flat, who = flat[order], who[order]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (who[1:] != who[:-1])]) if len(flat) else np.zeros(0, bool)
        more, times = np.unique(flat[new], return_counts=True)
        seen, where = np.unique(np.concatenate([seen, more]), return_inverse=True)
        count = np.bincount(where, np.concatenate([count, times]), len(seen)).astype(np.int64)
    keep = (count >= LEAST_DOCUMENTS) & (seen != 0)
    seen, count = seen[keep], count[keep]
    at = (seen & np.uint64(BUCKETS - 1)).astype(np.int64)
    tags = np.zeros(BUCKETS, np.uint64)
    order = np.lexsort((-seen.astype(np.float64), count))
    tags[at[order]] = seen[order]
    tags[0] = 0
    return tags


def train(texts: list[str | None], labels: np.ndarray, toxic_share: float) -> Net:
    """Fit on whole texts. ``toxic_share`` is the share of toxic rows among all labelled training rows."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net = Net(np.zeros(BUCKETS, np.uint64))
        net.constant = float(min(0.99, max(0.01, toxic_share))) if len(labels) else 0.0
        return net
    whole = pa.array(texts, pa.large_string())
    net = Net(owners(features(data, offsets) for _, _, data, offsets in tb.chunks(whole)))
    # of each document only its buckets, in 4 bytes, and its language stay in memory
    docs: list[np.ndarray] = []
    lang = np.zeros(len(labels), np.int64)
    for low, high, data, offsets in tb.chunks(whole):
        found, doc = features(data, offsets)
        lang[low:high] = net.language(found[:, 0], doc, high - low)
        docs += np.split(net.slots(found), np.searchsorted(doc, np.arange(1, high - low)))
    rng = np.random.default_rng(3)
    order = rng.permutation(len(docs))
    hold, fit = order[: len(order) // 5], order[len(order) // 5 :]

    def batch(rows):
        return np.concatenate([docs[i] for i in rows]), np.repeat(np.arange(len(rows)), [len(docs[i]) for i in rows])

    memory: dict = {}
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(fit))))):
        rng.shuffle(fit)
        loss = [net.step(*batch(fit[i : i + BATCH]), labels[fit[i : i + BATCH]], memory, 0.15) for i in range(0, len(fit), BATCH)]
        if np.mean(loss) < 0.002:
            break
    judged = np.concatenate([hold, fit]) if len(hold) < 400 else hold
    logit = np.concatenate([net.logits(*batch(judged[i : i + 256]), len(judged[i : i + 256])) for i in range(0, len(judged), 256)])
    calibrate(net, logit, lang[judged], labels[judged], toxic_share)
    return net


def best_limit(logit: np.ndarray, label: np.ndarray, toxic_share: float) -> float:
    """The logit above which calling a text toxic errs least at the true share; the middle of the best range."""
    order = np.argsort(logit, kind="stable")
    logit, label = logit[order].astype(np.float64), label[order]
    weight = np.where(label > 0, toxic_share / max(1, (label > 0).sum()), (1 - toxic_share) / max(1, (label == 0).sum()))
    missed = np.concatenate([[0], np.cumsum(weight * (label > 0))])
    wrong = np.concatenate([[0], np.cumsum((weight * (label == 0))[::-1])])[::-1]
    cost = missed + wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    best = best[len(best) // 2]
    low = logit[best - 1] if best else logit[0] - 2
    high = logit[best] if best < len(logit) else logit[-1] + 2
    return float((low + high) / 2)


def calibrate(net: Net, logit: np.ndarray, lang: np.ndarray, label: np.ndarray, toxic_share: float) -> None:
    overall = best_limit(logit, label, toxic_share)
    for k in range(len(LANGUAGES)):
        own = lang == k
        enough = (label[own] > 0).sum() >= 8 and (label[own] == 0).sum() >= 8
        net.limits[k] = best_limit(logit[own], label[own], toxic_share) if enough else overall


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col="doc_id", text_col="text", ones=TRAIN_TOXIC, zeros=TRAIN_CLEAN) -> tuple[DataFrame, float]:
    """((id, label, text), share of ones): bounded by ``ones`` and ``zeros``; fold 0 of the ids is left out."""
    known = labels.filter(F.col(label).isin(0, 1) & (fold(F.col(id_col)) != 0)).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    texts = docs.filter(fold(F.col(id_col)) != 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_hash = F.xxhash64("id")
    chosen = known.filter("label = 1").orderBy(by_hash, "id").limit(ones).unionByName(known.filter("label = 0").orderBy(by_hash, "id").limit(zeros))
    share = known.agg(F.avg("label")).first()[0]
    return texts.join(F.broadcast(chosen), "id").select("id", "label", "text"), float(share or 0.0)


def trained(sample: DataFrame, share: float, train_model):
    """The model that ``train_model(texts, labels, share)`` makes of a bounded sample, trained in one task."""

    def run(frames):
        import pandas as pd

        rows = pd.concat([pd.DataFrame({"id": [], "label": [], "text": []}), *frames], ignore_index=True)
        rows = rows.sort_values(["id", "label", "text"], kind="stable", na_position="first")
        texts = [t if isinstance(t, str) else None for t in rows.text]
        model = zlib.compress(pickle.dumps(train_model(texts, rows.label.to_numpy(np.float32), share)), 1)
        del rows, texts
        tb.release()
        yield pd.DataFrame({"model": [model]})

    made = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(zlib.decompress(made[0].model)) if made else train_model([], np.zeros(0, np.float32), share)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label="toxic") -> Net:
    return trained(*labelled_sample(docs, labels, label, id_col, text_col), train)


def score_documents(df: DataFrame, net: Net, text_col: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` with a score and a prediction, in columns named by ``into``."""
    sent = df.sparkSession.sparkContext.broadcast(net)
    names = [c for c in df.columns if c not in into]
    at = names.index(text_col)
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for low, high, data, offsets in tb.chunks(batch.column(at)):
                found, doc = features(data, offsets)
                score[low:high] = model.scores(found, doc, high - low)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*names, *into]
            )
            tb.release()

    return df.select(*names).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, net).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
