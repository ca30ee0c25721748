"""Toxicity by multiple-instance learning.

A document is a bag of sentences (ended by ``. ! ?`` or a line feed).  A
sentence has a logistic score over hashed features of its words: the word
itself and its first bytes, so that inflected forms share evidence.  The bag's
score is the noisy-or of its sentences, ``1 - prod(1 - p)``; only documents
carry labels, and the loss on the bag's score trains the sentence model.
Scored sentences then tell where a document offends.

Training takes at most ``MAX_TOXIC`` labelled toxic and ``MAX_CLEAN`` labelled
clean documents, and ``MAX_BYTES`` bytes of either, chosen by a hash; the bounds
are parameters, and weights restore the true shares.  Scoring covers whole texts.

Defined results: null and empty texts have no sentences and score the prior of
an empty bag (0.0); without labelled rows of both kinds every score is 0.0;
repeated rows score alike; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrayq.llm.shared import arrow_map, discard, materialise
from arrayq.llm.spans import Texts, slices

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8, 9)
MAX_TOXIC = 1500
MAX_CLEAN = 3000
#: Bytes of text of either kind that are trained on at most, besides the last document's own.
MAX_BYTES = 16 << 20
MIN_DOCS = 5
MIN_Z = 6.0
STEPS = 150
DECAY = 1e-5
PREDICT_AT = 0.7
#: Sentences at or above this score are reported as offending.
SENTENCE_AT = 0.3
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
#: Bytes inside words: ASCII letters and digits, and everything beyond ASCII.
_OUTSIDE = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


@dataclass
class Sentences:
    """Words of some texts grouped into sentences: ``starts[first[i]:first[i + 1]]`` are those of sentence ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    features: np.ndarray


def sentences(part: Texts) -> Sentences:
    """Sentences with at least a word, and (n_words, n_kinds) feature buckets."""
    low = part.lowered()
    starts, ends, at = low.words(_OUTSIDE)
    ended = np.concatenate(([0], np.cumsum(_END[low.data])))[starts]
    owner = np.repeat(np.arange(len(part)), np.diff(at))
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (ended[1:] != ended[:-1]))) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    kinds = [low.hashes(starts, ends)] + low.prefix_hashes(starts, ends, PREFIXES)
    features = np.stack([(h >> np.uint64(64 - 20)).astype(np.int32) for h in kinds], 1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    return Sentences(starts, ends, np.concatenate((first, [len(starts)])), owner[first], features)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, s: Sentences) -> np.ndarray:
        """A logit for each sentence."""
        if not len(s.owner):
            return np.zeros(0)
        each = self.weights[s.features].sum(1, dtype=np.float64)
        return np.add.reduceat(each, s.first[:-1]) + self.bias

    def scores(self, s: Sentences, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or for each of ``n`` bags, and the sentences' own scores."""
        z = self.logits(s)
        clean = np.bincount(s.owner, weights=np.logaddexp(0, z), minlength=n)
        return -np.expm1(-clean), _sigmoid(z)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> Model:
    """Fits the sentence model to document labels by full-batch Adam on the noisy-or likelihood."""
    y, column = labels.astype(bool), pa.array(texts, pa.large_string())
    # features that stand in clearly more toxic documents than chance has it, numbered from 0
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for part in slices(column):
        s = sentences(part)
        doc = np.repeat(s.owner, np.diff(s.first)).astype(np.int64)
        pairs = np.unique((doc[:, None] * BUCKETS + s.features).ravel())
        hit, inside = pairs % BUCKETS, y[part.first + pairs // BUCKETS]
        seen += np.bincount(hit, minlength=BUCKETS)
        toxic += np.bincount(hit, weights=inside, minlength=BUCKETS)
    expected = seen * y.mean()
    known = np.flatnonzero((seen >= MIN_DOCS) & (toxic - expected > MIN_Z * np.sqrt(expected)))
    numbers = np.full(BUCKETS, -1)
    numbers[known] = np.arange(len(known))
    cells, owners, base = [], [], 0
    for part in slices(column):
        s = sentences(part)
        number = numbers[s.features]
        at = np.repeat(np.arange(len(s.owner)), np.diff(s.first)) + base
        cells.append((at[:, None] * max(1, len(known)) + number)[number >= 0])
        owners.append(s.owner + part.first)
        base += len(s.owner)
    owner = np.concatenate(owners)
    # (sentence, feature) cells with how often they occur
    flat, times = np.unique(np.concatenate(cells), return_counts=True)
    row, number = flat // max(1, len(known)), flat % max(1, len(known))
    times = times.astype(np.float64)

    w, bias = np.zeros(len(known) + 1), -8.0
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    scale = weights / weights.sum()
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[number] * times, minlength=base) + w[-1]
        p = _sigmoid(z)
        bag = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(texts))
        # d loss / d bag: 1 for clean documents, -1 / (e^bag - 1) for toxic ones
        pull = np.where(y, -1 / np.expm1(np.clip(bag, 1e-4, 500)), 1.0) * scale
        dz = pull[owner] * p
        g = np.concatenate((np.bincount(number, weights=dz[row] * times, minlength=len(known)), [dz.sum()]))
        g[:-1] += DECAY * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    out = np.zeros(BUCKETS, np.float32)
    out[known] = w[:-1]
    return Model(out, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model | None:
    """Trains on labelled documents that are not held out, of each kind at most ``max_bytes``; null where one of the two kinds is missing."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    totals = {y: n for y, n in marks.groupBy("y").agg(F.count(F.lit(1))).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    key = F.xxhash64("doc_id", F.lit(5))
    wanted = marks.where("y = 1").orderBy(key, "doc_id").limit(max_toxic).unionByName(marks.where("y = 0").orderBy(key, "doc_id").limit(max_clean))
    # at most max_toxic + max_clean ids: a proven bound; of rows that repeat an id the least text counts
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    found = materialise(found, "toxicity-sample")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("y").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = found.select("doc_id", "y", key.alias("key"), F.octet_length("text").alias("size")).withColumn("before", before).where(F.col("before") <= max_bytes)
    rows = found.join(F.broadcast(taken.select("doc_id", "y")), ["doc_id", "y"], "left_semi").orderBy("doc_id", "y").collect()
    discard(found)
    if len({r.y for r in rows}) < 2:
        return None
    y = np.array([r.y for r in rows])
    share = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])
    return train([r.text or "" for r in rows], y, share[y])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences (count; byte range and score of the worst)."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "score", "predicted", "n_offending", "worst_start", "worst_end", "worst_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                n, own = len(part), batch.slice(part.first, len(part))
                score, count, place = np.zeros(n), np.zeros(n, np.int64), np.full((n, 2), -1, np.int64)
                worst = np.zeros(n)
                if model is not None:
                    s = sentences(part)
                    score, each = model.scores(s, n)
                    count = np.bincount(s.owner, weights=each >= SENTENCE_AT, minlength=n).astype(np.int64)
                    order = np.lexsort((-s.first[:-1], each, s.owner))
                    last = order[np.concatenate((s.owner[order][1:] != s.owner[order][:-1], [True]))] if len(order) else order
                    worst[s.owner[last]] = each[last]
                    at = part.at[s.owner[last]]
                    place[s.owner[last]] = np.stack((s.starts[s.first[last]] - at, s.ends[s.first[last + 1] - 1] - at), 1)
                score = np.clip(score, 0, 1)
                made = [pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32)), pa.array(count), pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array(worst)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *made], names)

    return arrow_map(narrow, run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_offending long, worst_start long, worst_end long, worst_score double")


def locate(model: Model, text: str, at: float = SENTENCE_AT) -> list[tuple[int, int, float]]:
    """Byte ranges of the sentences of ``text`` that score at least ``at``, with their scores."""
    found = []
    for part in slices(pa.array([text], pa.large_string())):
        s = sentences(part)
        _, each = model.scores(s, 1)
        found += [(int(s.starts[s.first[i]]), int(s.ends[s.first[i + 1] - 1]), float(each[i])) for i in np.flatnonzero(each >= at)]
    return found


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on ``labels(doc_id, toxic)`` and scores every document."""
    return predict(docs, fit(docs, labels))
