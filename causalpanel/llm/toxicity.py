"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence's score is logistic in its
features (words and their beginnings); a document's is the noisy-or of its sentences' scores. Both
are fitted together to the document labels, so that the sentences that offend carry the weight and
can be located.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, row_key, ship

#: Labelled documents that the fit uses at most, about (a hash-random sample).
MOST_LABELLED = 20_000
#: A feature is in so many toxic documents of the sample at least, in such a share of them, and its
#: share among them is above that among the others by so many standard errors. The share bounds the
#: features: there are 1 / LEAST_SHARE times as many at most as a toxic document has on average.
LEAST_DOCS, LEAST_SHARE, LEAST_Z = 5, 0.02, 5.0
FOLDS = 5
#: Lengths of the beginnings of words that count as features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
ROUNDS, RATE, RIDGE = 600, 0.1, 0.02
SENTENCE, LETTERS = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")
#: Counted features that a task holds before it hands them on.
HELD = 200_000
#: Words without features that a Python worker remembers.
CLEAN = 500_000


def features(word: str) -> list[str]:
    """The features of a lower-case word."""
    return [f"={word}", *[f"{word[:k]}*" for k in PREFIXES if len(word) > k]]


@dataclass
class Model:
    """Weights by feature and the bias of a sentence; ``bias`` None: nothing could be learnt."""

    weights: dict[str, float]
    bias: float | None

    def __post_init__(self):
        self.clean: set[str] = set()

    def told(self, words: set[str]) -> dict[str, list[str]]:
        """The words that have features of the model, with these."""
        if len(self.clean) > CLEAN:
            self.clean.clear()
        found = {}
        for w in words - self.clean:
            own = [f for f in features(w) if f in self.weights]
            if own:
                found[w] = own
            else:
                self.clean.add(w)
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text and (start, end, score) of the sentences that score a half or more."""
        if self.bias is None or not text:
            return 0.0, []
        low = text.lower()
        low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        told = self.told(set(LETTERS.findall(low)))
        if not told:
            n = sum(1 for s in SENTENCE.finditer(low) if LETTERS.search(s[0]))
            return float(-np.expm1(-n * np.logaddexp(0, self.bias))), []
        total, found = 0.0, []
        for s in SENTENCE.finditer(low):
            words = LETTERS.findall(s[0])
            if not words:
                continue
            own = {f for w in words if w in told for f in told[w]}
            z = self.bias + sum(self.weights[f] for f in sorted(own))
            total += float(np.logaddexp(0, z))
            if z >= 0:
                found.append((s.start(), s.end(), float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(-total)), found


def fit_noisy_or(labels: np.ndarray, sentences: np.ndarray, owner: np.ndarray, row: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias that fit noisy-or document scores to the labels (Adam on the log loss).

    ``sentences``: sentences without any feature, by document; ``owner``: the document of each
    sentence with features; (``row``, ``column``): its features.
    """
    n, b = len(labels), -6.0
    # begin with the features that mostly toxic documents have
    w = -0.7 * b * (np.bincount(column, labels[owner[row]], width) > 0.8 * np.bincount(column, minlength=width))
    moments, squares = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, ROUNDS + 1):
        z = b + np.bincount(row, w[column], len(owner))
        total = np.bincount(owner, np.logaddexp(0, z), n) + sentences * np.logaddexp(0, b)
        total = np.maximum(total, 1e-12)
        by_doc = np.where(labels == 1, -np.exp(-total) / -np.expm1(-total), 1.0) / n
        slope = by_doc[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(column, slope[row], width) + RIDGE * w / len(labels), slope.sum() + (by_doc * sentences).sum() / (1 + np.exp(-b)))
        moments, squares = 0.9 * moments + 0.1 * grad, 0.99 * squares + 0.01 * grad**2
        step = RATE * (moments / (1 - 0.9**k)) / (np.sqrt(squares / (1 - 0.99**k)) + 1e-9) * min(1.0, 2 * (1 - (k - 1) / ROUNDS))
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    """The fold of crc32(doc_id as text) mod 5 that labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit to the labelled rows outside the held-out fold.

    The sample is all of them or, if there are more than MOST_LABELLED, as many by a hash of the id;
    its size bounds everything that reaches the driver. Features are chosen over the whole sample.
    Labels that are null, not 0 or 1 or of ids without text are ignored; contradicting labels of one
    id count as 1. A one-sided sample teaches nothing: all scores are then 0.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    share = min(1.0, MOST_LABELLED / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    sample = cut(sample.join(F.broadcast(chosen), "doc_id").select("text", "_y"))  # about MOST_LABELLED ids
    sides = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    n1, n0 = sides.get(1, 0), sides.get(0, 0)
    if not n1 or not n0:
        return Model({}, None)

    def counted(batches):
        def handed(both):
            keys = list(both[0] | both[1])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in both]], ["feature", "n0", "n1"])

        both = (Counter(), Counter())
        for batch in batches:
            for body, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                both[y].update({f for w in set(LETTERS.findall(body.lower())) for f in features(w)})
                if len(both[0]) + len(both[1]) > HELD:
                    yield handed(both)
                    both = (Counter(), Counter())
        yield handed(both)

    table = sample.mapInArrow(counted, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    table = table.where(F.col("n1") >= max(LEAST_DOCS, LEAST_SHARE * n1)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    names = [r["feature"] for r in table.orderBy(F.desc("z"), "feature").select("feature").collect()]
    if not names:
        return Model({}, None)
    place = {f: k for k, f in enumerate(names)}

    def bags(batches):
        for batch in batches:
            plain, told = [], []
            for body in batch.column("text").to_pylist():
                empty, found = 0, []
                for s in SENTENCE.finditer(body.lower()):
                    own_words = LETTERS.findall(s[0])
                    own = sorted({place[f] for w in own_words for f in features(w) if f in place})
                    if own:
                        found.append(own)
                    else:
                        empty += bool(own_words)
                plain.append(empty)
                told.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(plain, pa.int32()), pa.array(told, pa.list_(pa.list_(pa.int32())))], ["_y", "plain", "told"])

    found = sample.mapInArrow(bags, "_y int, plain int, told array<array<int>>").toArrow()
    y, plain = found["_y"].to_numpy().astype(float), found["plain"].to_numpy().astype(float)
    told = found["told"].combine_chunks()
    per_doc = np.diff(told.offsets.to_numpy())
    inner = told.flatten()
    per_sentence = np.diff(inner.offsets.to_numpy())
    owner, row = np.repeat(np.arange(len(y)), per_doc), np.repeat(np.arange(len(per_sentence)), per_sentence)
    w, b = fit_noisy_or(y, plain, owner, row, inner.flatten().to_numpy(), len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, offending, _k1, _k2.

    ``offending`` lists start, end (characters) and score of the sentences that score a half or
    more. Whole texts are read; a null or empty text scores 0. Repeated rows come back each time;
    other columns are not read; an empty table gives an empty result.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def scored(batches):
        for batch in batches:
            scores, spans = [], []
            for at in range(0, batch.num_rows, 256):
                for body in batch.column("text").slice(at, 256).to_pylist():
                    s, found = model.score(body)
                    scores.append(min(1.0, max(0.0, s)))
                    spans.append([{"start": a, "end": b, "score": x} for a, b, x in found])
            kept = [batch.column(c) for c in ("doc_id", "held_out", "_k1", "_k2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "held_out", "_k1", "_k2", "score", "offending"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    kind = "doc_id long, held_out boolean, _k1 long, _k2 long, score double, offending array<struct<start int, end int, score double>>"
    return d.mapInArrow(scored, kind).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs``, all columns, without the rows whose text is predicted to be toxic.

    Null and empty texts stay, repeated rows share their fate, an empty table stays empty.
    """
    bad = score(docs, train(docs, labels, doc_id, text, label), doc_id, text).where("predicted = 1").select("_k1", "_k2").distinct()
    return keyed(docs, doc_id, text).join(bad, ["_k1", "_k2"], "left_anti").select("_doc.*")
