"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability p = sigmoid(b + sum of the weights of its features), the
document the noisy-or 1 - prod(1 - p). Only documents carry labels: the likelihood of the document labels is maximised, and
the sentence probabilities that this teaches locate the offending sentences afterwards.

Features of a sentence: hashed words (runs of letters, A-Z lower-cased) and their first 4 to 8 bytes, so that inflected forms
of a stem share evidence. Fitting uses at most `max_docs` labelled rows (those with the smallest hashes of doc_id) of at most
`max_bytes` each; both bounds are parameters. Scoring reads every whole text.

Defined results: a null text is an empty text; a text without letters has one sentence without features; a null label counts
as no label, and of repeated labels of one doc_id the largest counts; each input row gives one row; other columns are ignored;
with no labels at all the score is that of the prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from .shared import filter_slices, map_slices

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


@dataclass
class Sentences:
    """Sentences of a slice: document, byte span, and features as a ragged array."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    features: np.ndarray
    offsets: np.ndarray


def sentences(texts: pa.Array, bits: int = BITS) -> Sentences:
    """Cuts texts after a newline, or after . ! ? before white space; every text has at least one sentence."""
    buf, off = B.flat(texts)
    n = len(buf)
    stop_here = buf == 10
    if n:
        after_space = np.ones(n, bool)
        after_space[:-1] = B.SPACE[buf[1:]]
        stop_here |= _END[buf] & after_space
    cuts = np.zeros(n + 1, bool)
    cuts[1:] = stop_here
    cuts[off] = True
    bounds = np.flatnonzero(cuts[:-1]) if n else np.zeros(0, np.int64)
    starts = np.unique(np.concatenate([bounds, off[:-1]]))
    doc = np.searchsorted(off[:-1], starts, "right") - 1
    stops = np.append(starts[1:], n)
    empty = np.setdiff1d(np.flatnonzero(np.diff(off) == 0), doc)  # texts that share their offset with the next one
    low = B.LOWER[buf]
    ws, we, wd = B.runs(B.LETTER[buf] if n else np.zeros(0, bool), off)
    whole, part = B.word_hashes(low, ws, we, PREFIXES)
    sent = np.searchsorted(starts, ws, "right") - 1
    columns = [whole] + [part[k] for k in PREFIXES]
    ids = np.concatenate([sent] + [sent] * len(PREFIXES))
    feats = np.concatenate(columns)
    keep = feats != 0
    ids, feats = ids[keep], (feats[keep] >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(ids, kind="stable")
    ids, feats = ids[order], feats[order]
    if len(empty):
        starts, stops = np.concatenate([starts, off[empty]]), np.concatenate([stops, off[empty]])
        doc = np.concatenate([doc, empty])
        order = np.argsort(doc, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        starts, stops, doc, ids = starts[order], stops[order], doc[order], moved[ids]
    counts = np.bincount(ids, minlength=len(starts)) if len(ids) else np.zeros(len(starts), np.int64)
    return Sentences(doc, starts - off[doc], stops - off[doc], feats, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a ragged array's rows, empty rows included; each is made of its own values alone."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), offsets[full])
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class NoisyOr:
    weights: np.ndarray
    bias: float

    def logits(self, s: Sentences) -> np.ndarray:
        return self.bias + _sums(self.weights[s.features], s.offsets)

    def documents(self, s: Sentences, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Document scores and sentence probabilities."""
        z = self.logits(s)
        survive = np.bincount(s.doc, weights=np.logaddexp(0, z), minlength=n)
        return -np.expm1(-survive), _sigmoid(z)


def _evidence(batches, bits: int, least: float = 3.0, most: float = 12.0) -> np.ndarray:
    """How strongly a feature's presence goes with the label over the training documents, from 0 to 1.

    The excess of positive documents over those expected, in standard deviations: below `least` a feature stays out, so that
    the words of single positive documents are not learnt by heart."""
    every, positive, rows, hits = np.zeros(1 << bits), np.zeros(1 << bits), 0, 0.0
    for s, y in batches:
        pairs = np.unique(np.repeat(s.doc, np.diff(s.offsets)).astype(np.int64) << bits | s.features)
        f, d = pairs & ((1 << bits) - 1), pairs >> bits
        every += np.bincount(f, minlength=1 << bits)
        positive += np.bincount(f, weights=y[d], minlength=1 << bits)
        rows, hits = rows + len(y), hits + y.sum()
    expected = every * hits / max(rows, 1)
    z = np.abs(positive - expected) / np.sqrt(expected + 1)
    return np.where(z >= least, np.minimum(z, most) / most, 0)


def _only(s: Sentences, keep: np.ndarray) -> Sentences:
    """The same sentences with the features in `keep` alone."""
    hit = keep[s.features]
    total = np.concatenate([[0], np.cumsum(hit)])
    return Sentences(s.doc, s.start, s.stop, s.features[hit], total[s.offsets])


def fit(texts: list[str], labels: list[int], bits: int = BITS, epochs: int = 16, rate: float = 1.0, l2: float = 1e-6, batch: int = 32) -> NoisyOr:
    """Adagrad on the noisy-or likelihood; the order of the rows is fixed by a seed."""
    weights, bias = np.zeros(1 << bits), -6.0
    y_all = np.asarray(labels, float)
    if not len(texts):
        return NoisyOr(weights, bias)
    seen, seen_b = np.full(1 << bits, 1e-2), 1e-2
    rng = np.random.default_rng(7)
    order = rng.permutation(len(texts))

    def batches():
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            yield sentences(pa.array([texts[r] for r in rows], pa.string()), bits), y_all[rows]

    scale = _evidence(batches(), bits)
    groups = [(_only(s, scale > 0), y) for s, y in batches()]  # read twice, so that only the features in use stay in memory
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            s, y = groups[g]
            z = bias + _sums(weights[s.features], s.offsets)
            total = np.bincount(s.doc, weights=np.logaddexp(0, z), minlength=len(y))
            miss = np.exp(-total)
            slope = (1 - y) - y * miss / np.maximum(1 - miss, 1e-9)  # d loss / d total
            dz = np.clip(slope[s.doc] * _sigmoid(z), -4, 4)
            grad = scale * np.bincount(s.features, weights=np.repeat(dz, np.diff(s.offsets)), minlength=1 << bits) / len(y) + l2 * weights
            seen += grad * grad
            weights -= scale * rate * grad / np.sqrt(seen)
            gb = dz.sum() / len(y)
            seen_b += gb * gb
            bias -= rate * gb / np.sqrt(seen_b)
    return NoisyOr(weights.astype(np.float32), float(bias))


def score(documents: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score, n_sentences, worst_start, worst_end (byte span of the most offensive sentence), worst_score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2^18 numbers, whatever the input

    def work(part):
        s = sentences(part.column("text"))
        n = part.num_rows
        docs, each = shared.value.documents(s, n)
        order = np.lexsort((s.start, -each, s.doc))
        first = order[np.searchsorted(s.doc[order], np.arange(n))]
        yield {
            "doc_id": part.column("doc_id"), "score": docs, "n_sentences": np.bincount(s.doc, minlength=n).astype(np.int64),
            "worst_start": s.start[first], "worst_end": s.stop[first], "worst_score": each[first],
        }

    kind = dict(documents.dtypes)["doc_id"]
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, score double, n_sentences long, worst_start long, worst_end long, worst_score double", work)


def clean(documents: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below `threshold`."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return filter_slices(documents, lambda part: shared.value.documents(sentences(part.column("text")), part.num_rows)[0] < threshold)


def locate(documents: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """One row for each sentence with a probability of `threshold` or more: doc_id, byte span, probability, the sentence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(part):
        s = sentences(part.column("text"))
        _, each = shared.value.documents(s, part.num_rows)
        hit = np.flatnonzero(each >= threshold)
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        yield {
            "doc_id": part.column("doc_id").take(pa.array(s.doc[hit])), "start": s.start[hit], "stop": s.stop[hit], "probability": each[hit],
            "sentence": pa.array([texts[d][a:b].decode(errors="replace") for d, a, b in zip(s.doc[hit], s.start[hit], s.stop[hit])], pa.string()),
        }

    kind = dict(documents.dtypes)["doc_id"]
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, start long, stop long, probability double, sentence string", work)
