"""Language ID by a byte convolutional network, trained in numpy.

A window of ``WINDOW`` bytes goes through filters of several widths over learned
byte embeddings; each filter keeps its largest response (max pooling), and a
softmax layer reads those.  Because a filter is a sum of one table look-up per
byte, the trained network is folded into tables for pairs of bytes, and whole
batches of windows are scored with a few gathers and maxima.  A text of any
length is cut into windows that cover it all; the windows' log-probabilities
are averaged by their bytes.

Training uses at most ``SAMPLE`` labelled documents, a window from each, chosen
by a hash; the bound is a parameter.  Everything else covers whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score
0.0; without any labelled text every other prediction is ``und`` too; repeated
rows are predicted alike; an empty table gives an empty table; extra columns
are ignored by :func:`predict` and kept by :func:`language_filter`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayq.llm.shared import arrow_map
from arrayq.llm.spans import slices

WINDOW = 128
WIDTHS = (2, 4)
FILTERS = 16
EMBEDDING = 12
SAMPLE = 4000
EPOCHS = 6
MIN_SCORE = 0.5
UNKNOWN = "und"
_GATHER = 512  # windows that are scored together


@dataclass
class Network:
    """Folded tables: for each width, one (65536, FILTERS) table per pair of bytes in the filter."""

    labels: list[str]
    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """For each row of bytes the labels' log-probabilities."""
        # bytes along the first axis, so that the maximum runs over whole planes
        b = np.ascontiguousarray(windows.T).astype(np.int32)
        pairs = (b[:-1] << 8) | b[1:]
        pooled = []
        for parts, bias in zip(self.tables, self.bias, strict=True):
            n = len(b) - 2 * len(parts) + 1
            total = parts[0][pairs[:n]]
            for k, part in enumerate(parts[1:], 1):
                total += part[pairs[2 * k : 2 * k + n]]
            pooled.append(np.maximum(total.max(0) + bias, 0))
        z = np.concatenate(pooled, 1) @ self.weights + self.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(windows: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fits the network to (n, WINDOW) bytes; Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.searchsorted(names, labels)
    n_labels, pool = len(names), FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "w": rng.normal(0, 0.1, (pool, n_labels)), "o": np.zeros(n_labels)}
    for w in WIDTHS:
        p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            rows = order[i : i + 64]
            x, n = windows[rows], len(rows)
            emb = p["e"][x]
            parts, pooled = {}, []
            for w in WIDTHS:
                view = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], 2)
                r = view @ p[f"f{w}"]
                top = r.argmax(1)
                best = np.take_along_axis(r, top[:, None], 1)[:, 0] + p[f"b{w}"]
                parts[w] = (view, top, best > 0)
                pooled.append(np.maximum(best, 0))
            h = np.concatenate(pooled, 1)
            z = h @ p["w"] + p["o"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), y[rows]] -= 1
            q /= n
            g = {"w": h.T @ q, "o": q.sum(0), "e": np.zeros_like(p["e"])}
            back = q @ p["w"].T
            for j, w in enumerate(WIDTHS):
                view, top, live = parts[w]
                d = back[:, j * FILTERS : (j + 1) * FILTERS] * live
                hit = view[np.arange(n)[:, None], top]  # (n, FILTERS, w * EMBEDDING)
                g[f"f{w}"], g[f"b{w}"] = np.einsum("nf,nfe->ef", d, hit), d.sum(0)
                spread = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
                for k in range(w):
                    np.add.at(g["e"], x[np.arange(n)[:, None], top + k], spread[:, :, k])
            step += 1
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    tables = []
    for w in WIDTHS:
        taps = [(p["e"] @ p[f"f{w}"][k * EMBEDDING : (k + 1) * EMBEDDING]).astype(np.float32) for k in range(w)]
        tables.append([(taps[k][:, None] + taps[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w, 2)])
    return Network(names, tables, [p[f"b{w}"].astype(np.float32) for w in WIDTHS], p["w"].astype(np.float32), p["o"].astype(np.float32))


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, and the accented capitals of Latin-1 as small letters."""
    out = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:] += after.astype(np.uint8) * np.uint8(32)
    return out


def _fold(text: bytes) -> np.ndarray:
    out = np.full(WINDOW, 32, np.uint8)
    cut = _lowered(np.frombuffer(text[:WINDOW], np.uint8))
    out[: len(cut)] = cut
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that training leaves out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Trains on at most ``sample`` windows from documents that are not held out; null where there is nothing to learn from."""
    text = F.col("text").cast("string")
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    key = F.xxhash64("doc_id", F.lit(11))
    # about twice the sample pass this hash threshold, so tasks send few rows however many there are
    share = min(1.0, 2 * sample / max(1, labelled.count()))
    mine = labelled.where((F.abs(key % 1_000_003) < F.lit(share * 1_000_003)) & text.rlike(r"\p{L}"))
    at = F.pmod(F.shiftright(key, 20), F.greatest(F.lit(1), F.length(text) - WINDOW)).cast("int") + 1
    windows = mine.select(F.substring(text, at, F.lit(WINDOW)).alias("t"), F.col("lang").cast("string").alias("lang"), key.alias("k"))
    rows = windows.orderBy("k", "t").limit(sample).collect()
    if not rows:
        return None
    return train(np.stack([_fold(r.t.encode()) for r in rows]), [r.lang for r in rows])


def _score(network: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    found, score = [UNKNOWN] * len(column), np.zeros(len(column))
    if network is None:
        return found, score
    for part in slices(column):
        sizes = np.diff(part.at)
        per = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(part)), per)
        heads = np.concatenate(([0], np.cumsum(per)))
        # windows cover each text from its start; the last one is filled up with spaces
        at = part.at[owner] + (np.arange(len(owner)) - heads[owner]) * WINDOW
        size = np.minimum(WINDOW, part.at[owner + 1] - at)
        padded = np.concatenate((_lowered(part.data), np.full(WINDOW, 32, np.uint8)))
        logs = np.empty((len(owner), len(network.labels)))
        for i in range(0, len(owner), _GATHER):
            j = slice(i, i + _GATHER)
            block = padded[at[j, None] + np.arange(WINDOW)[None]]
            block[np.arange(WINDOW)[None] >= size[j, None]] = 32
            logs[j] = network.log_probabilities(block)
        total = np.zeros((len(part) + 1, len(network.labels)))
        sums = np.concatenate((total[:1], np.cumsum(logs * size[:, None], 0)))
        mean = (sums[heads[1:]] - sums[heads[:-1]]) / np.maximum(sizes, 1)[:, None]
        chance = np.exp(mean - mean.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        top = chance.argmax(1)
        for i in np.flatnonzero(letters[part.first : part.first + len(part)]):
            found[part.first + i], score[part.first + i] = network.labels[top[i]], min(1.0, float(chance[i, top[i]]))
    return found, score


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = _score(network, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return arrow_map(narrow, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on the labelled part of ``docs`` and predicts every row."""
    return predict(docs, fit(docs, sample))


def language_filter(docs: DataFrame, sample: int = SAMPLE, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a recognised language, with all their columns; the text's pass is streamed, nothing is shuffled."""
    network, schema = fit(docs, sample), docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("text"))
            found, score = _score(network, column)
            keep = np.array([f != UNKNOWN and s >= min_score for f, s in zip(found, score, strict=True)], bool)
            yield batch.filter(pa.array(keep))

    return arrow_map(docs, run, schema)
