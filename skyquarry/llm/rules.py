"""Quality rules: counts of a text with fixed limits, and a calibrated n-gram classifier with a fixed threshold.

The counts are those of usual corpus rules (words, symbols, repeated lines and windows). The classifier is a logistic regression on hashed
n-grams: words and pairs of words, and runs of three and four characters (code points), case kept. A text is described by the share of each
n-gram among those of its kind, so that the logit is the intercept plus, for each kind, the mean weight of the text's n-grams. It is trained on
labelled rows; logits of texts that a model has not seen (three folds) are mapped to probabilities by Platt's method, and the model of all rows
is used with that map. Texts are scored in Arrow batches; a text is kept if the base rules pass and its probability is `THRESHOLD` or more.

The weights are whole numbers (units of 2^-16), so sums are exact and a score depends on the text alone, however rows are divided. Long texts
are read in blocks of `BLOCK` characters. Fitting uses at most `max_docs` labelled rows (those with the smallest hashes of doc_id) and of these, in
that order, no more than `max_chars` characters together; both bounds are parameters, and counting and scoring read every whole text.

Words, lines and windows are compared within one text only: lines as they are, words and windows by 64-bit hashes.

Defined results: a null text has no words; every row gives one row, repeated ids and rows included; a null label counts as no label, and of
repeated labels of one doc_id the largest counts, of repeated ids the smallest text; other columns are ignored. Without labels, or with one
class alone, the probability is that share of the class after adding one row of each (0.5 without labels), and 0.5 passes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import bounded_sample, map_slices

BITS = 18
BLOCK = 1 << 20
UNIT = 1 << 16
#: Fixed limits: least number of words, most repeated words in a hundred, least probability.
LEAST_WORDS, MOST_REPEATED, THRESHOLD = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Kinds of n-grams: words, pairs of words, characters by three and by four.
KINDS = 4
_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BLANK = np.zeros(128, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the joined texts; nulls are empty."""
    values = [t or "" for t in texts.to_pylist()]
    codes = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in values], dtype=np.int64)]).astype(np.int64)


def _is(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    return (codes < 128) & among[np.minimum(codes, 127)]


def hash_words(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of random values of its characters at their places, block by block."""
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(codes), BLOCK):
        b = min(a + BLOCK, len(codes))
        lo, hi = np.searchsorted(stops, a, "right"), np.searchsorted(starts, b)
        if lo == hi:
            continue
        s, e = np.maximum(starts[lo:hi], a), np.minimum(stops[lo:hi], b)
        inside = np.repeat(np.arange(hi - lo), e - s)
        at = np.arange(len(inside)) + np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s)
        place = (at - starts[lo:hi][inside]).astype(np.uint64)
        out[lo:hi] += np.add.reduceat(B.mix(codes[at] * _K[0] + place * _K[1] + _K[2]), np.cumsum(e - s) - (e - s))
    return B.mix(out)


@dataclass
class Words:
    """Words of a slice: code-point spans, texts, hashes; `bounds`: the span of each text's words."""

    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words_of(codes: np.ndarray, offsets: np.ndarray) -> Words:
    starts, stops, _ = B.runs(~_is(codes, _BLANK), offsets)
    return Words(starts, stops, hash_words(codes, starts, stops), np.searchsorted(starts, offsets))


def spans_sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Exact sums of values[a:b] for each span, 0 where b is not above a; values are whole numbers."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.where(stops > starts, total[np.clip(stops, 0, len(values))] - total[np.clip(starts, 0, len(values))], 0)


def base_counts(texts: pa.Array, codes: np.ndarray, offsets: np.ndarray, w: Words) -> dict[str, np.ndarray]:
    a, b = w.bounds[:-1], w.bounds[1:]
    doc = np.repeat(np.arange(len(a)), b - a)
    windows, of = B.shingles(w.hashes, doc, 3)
    first = np.arange(len(doc))[: max(len(doc) - 2, 0)]
    first = first[doc[first] == doc[first + 2]] if len(first) else first
    marked = np.zeros(len(doc) + 1, bool)
    if len(windows):
        order = np.lexsort((windows, of))
        twice = (windows[order][1:] == windows[order][:-1]) & (of[order][1:] == of[order][:-1])
        hit = np.zeros(len(windows), bool)
        hit[order[1:][twice]] = hit[order[:-1][twice]] = True
        for j in range(3):
            marked[first[hit] + j] = True
    dup = []
    for t in texts.to_pylist():
        lines = [x for x in (t or "").split("\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": b - a, "word_chars": spans_sums(w.stops - w.starts, a, b), "n_symbols": spans_sums(_is(codes, _SYMBOL), offsets[:-1], offsets[1:]),
        "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": spans_sums(marked[:-1], a, b),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


# -- n-grams

def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    """Hashes to places in the table of weights."""
    return ((h * _K[3] + _K[kind]) * _K[0] >> np.uint64(64 - BITS)).astype(np.int32)


def word_slots(w: Words) -> list[np.ndarray]:
    """Places of words, and of pairs by their first word (a pair over a text's end is never in a span)."""
    return [_slots(w.hashes, 0), _slots(B.mix(w.hashes[:-1] * _K[1] + w.hashes[1:]), 1)]


def char_slots(codes: np.ndarray, size: int) -> np.ndarray:
    """Places of the runs of `size` characters, by their first one."""
    n = max(len(codes) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * _K[2] + codes[j : j + n]
    return _slots(h ^ (h >> np.uint64(29)), size - 1)


@dataclass
class Model:
    """Whole-number weights by place, an intercept, and Platt's slope and shift."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.int32))
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, codes: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
        """The uncalibrated logits of a slice's texts."""
        n = len(offsets) - 1
        z = np.full(n, self.intercept)
        a, b = w.bounds[:-1], w.bounds[1:]
        for k, slots in enumerate(word_slots(w)):
            many = np.maximum(b - a - k, 0)
            z += spans_sums(self.weights[slots], a, a + many) / (np.maximum(many, 1) * UNIT)
        for size in (3, 4):
            total, many = np.zeros(n, np.int64), np.maximum(np.diff(offsets) - size + 1, 0)
            for lo in range(0, len(codes), BLOCK):
                hi = min(lo + BLOCK, len(codes))
                part = self.weights[char_slots(codes[lo : hi + size - 1], size)]
                s, e = np.clip(offsets[:-1], lo, hi), np.clip(offsets[:-1] + many, lo, hi)
                total += spans_sums(part, s - lo, np.minimum(e - lo, len(part)))
            z += total / (np.maximum(many, 1) * UNIT)
        return z

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


@dataclass
class Rows:
    """Sparse rows: for each text its places and their values; `ptr`: the span of each text's entries."""

    slots: np.ndarray
    values: np.ndarray
    ptr: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        per = np.diff(self.ptr)[rows]
        at = np.repeat(self.ptr[rows] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
        return Rows(self.slots[at], self.values[at], np.concatenate([[0], np.cumsum(per)]))

    def only(self, allowed: np.ndarray) -> Rows:
        keep = allowed[self.slots]
        return Rows(self.slots[keep], self.values[keep], np.concatenate([[0], np.cumsum(keep)])[self.ptr])

    def logits(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.values * weights[self.slots])])
        return total[self.ptr[1:]] - total[self.ptr[:-1]]


def rows_of(texts: list[str]) -> Rows:
    """The n-gram shares of texts, one text at a time."""
    slots, values, sizes = [], [], [0]
    for t in texts:
        codes, offsets = code_points(pa.array([t], pa.string()))
        kinds = [*word_slots(words_of(codes, offsets)), char_slots(codes, 3), char_slots(codes, 4)]
        both, weight = np.concatenate(kinds), np.concatenate([np.full(len(k), 1 / max(len(k), 1), np.float32) for k in kinds])
        own, at = np.unique(both, return_inverse=True)
        slots.append(own.astype(np.int32))
        values.append(np.bincount(at, weights=weight, minlength=len(own)).astype(np.float32))
        sizes.append(len(own))
    return Rows(np.concatenate(slots), np.concatenate(values), np.cumsum(sizes))


def _train(rows: Rows, y: np.ndarray, epochs: int, rate: float, l2: float, batch: int, least_docs: int) -> tuple[np.ndarray, float]:
    """Adagrad on the log-loss; the order of the rows is fixed by a seed. Places that fewer than `least_docs` rows have stay 0."""
    weights, rng = np.zeros(1 << BITS), np.random.default_rng(5)
    share = np.clip(y.mean(), 0.01, 0.99)
    intercept = float(np.log(share / (1 - share)))
    seen = np.full(1 << BITS, 1e-8)
    rows = rows.only(np.bincount(rows.slots, minlength=1 << BITS) >= least_docs)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            part, t = rows.take(order[i : i + batch]), y[order[i : i + batch]]
            z = intercept + part.logits(weights)
            slope = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - t) / len(t)
            on, at = np.unique(part.slots, return_inverse=True)
            grad = np.bincount(at, weights=part.values * np.repeat(slope, np.diff(part.ptr)), minlength=len(on)) + l2 * weights[on]
            seen[on] += grad * grad
            weights[on] -= rate * grad / np.sqrt(seen[on])
            intercept -= 0.2 * slope.sum()
    return weights, intercept


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the probabilities of logits, by Newton's method on Platt's smoothed targets; the slope is not below 0."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - target) * x).sum(), (p - target).sum()]) + 1e-3 * np.array([a, b])
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return max(float(a), 0.0) / scale, float(b)


def fit(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 2.0, l2: float = 1e-6, batch: int = 64, folds: int = 3, least_docs: int = 3) -> Model:
    """The model of labelled texts; folds go by the order of the texts."""
    y = np.asarray(labels, float)
    good, bad = float(y.sum()), float(len(y) - y.sum())
    if min(good, bad) < folds:  # too few of a class to learn it
        return Model(shift=float(np.log((good + 1) / (bad + 1))))
    rows, out = rows_of(texts), np.zeros(len(y))
    fold = np.zeros(len(y), int)
    for c in (0, 1):  # each class is dealt to the folds evenly
        fold[y == c] = np.arange(int((y == c).sum())) % folds
    how = {"epochs": epochs, "rate": rate, "l2": l2, "batch": batch, "least_docs": least_docs}
    for k in range(folds):
        weights, intercept = _train(rows.take(np.flatnonzero(fold != k)), y[fold != k], **how)
        out[fold == k] = intercept + rows.take(np.flatnonzero(fold == k)).logits(weights)
    slope, shift = platt(out, y)
    weights, intercept = _train(rows, y, **how)
    most = np.iinfo(np.int32).max
    return Model(np.clip(np.round(weights * UNIT), -most, most).astype(np.int32), intercept, slope, shift)


def fit_labelled(documents: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 4000, max_chars: int = 32_000_000) -> Model:
    """The model of the labelled rows of documents, fitted in one executor task on a bounded sample."""
    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = bounded_sample(known.join(texts.select("doc_id"), "doc_id", "left_semi"), F.col("doc_id"), max_docs)
    sizes = texts.select("doc_id", F.char_length("text").alias("size")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("size").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # at most max_docs rows
    chosen = sizes.withColumn("before", before).where(F.col("before") <= max_chars).select("doc_id", "y", "size")
    sample = texts.join(F.broadcast(chosen), "doc_id").where(F.char_length("text") == F.col("size")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        rows = sorted((str(i), t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())})

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], [])  # an empty table may have no task at all


def apply(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (probability) and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2^18 numbers, whatever the input

    def work(part):
        texts = part.column("text")
        codes, offsets = code_points(texts)
        w = words_of(codes, offsets)
        counts = base_counts(texts, codes, offsets, w)
        failed = base_failed(counts)
        quality = shared.value.probability(shared.value.logits(codes, offsets, w))
        yield {"doc_id": part.column("doc_id"), **counts, "base_failed": failed, "quality": quality, "kept": ~failed & (quality >= threshold)}

    kind = dict(documents.dtypes)["doc_id"]
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, {counts}, base_failed boolean, quality double, kept boolean", work)
