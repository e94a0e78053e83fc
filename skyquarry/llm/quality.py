"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes (the last may be shorter; an empty text is one empty passage). A passage is
described by surface statistics: shares of byte classes, of transitions between coarse classes, word lengths, shares of
distinct words and word pairs, capitalised and upper-case words, line lengths. An encoder h = tanh(W x + b) turns them into a
representation; gated attention weights a ~ exp(w . (tanh(V h) * sigmoid(U h))) are learnt from document labels alone, and the
document's score is sigmoid(c . sum(a h) + d).

Fitting uses at most `max_docs` labelled rows (those with the smallest hashes of doc_id) of at most `max_bytes` each; scoring
reads every whole text. Defined results: a null text is an empty text; null labels count as no labels, of repeated ones the
largest counts; each input row gives one row; other columns are ignored; with no labels at all every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from .shared import map_slices

PASSAGE = 1500

#: Byte classes: each lower-case letter, upper case, digit, blanks, line ends, marks of their own, other marks, UTF-8 lead and tail.
_MARKS = ".,;:!?'\"()[]{}<>|*#%&$@/\\=+-_~^"
_CLASS = np.full(256, 31 + len(_MARKS), np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS[ord("A") : ord("Z") + 1] = 26
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[[0x20, 9, 11, 12]] = 28
_CLASS[[10, 13]] = 29
_CLASS[0xC0:] = 30
_CLASS[0x80:0xC0] = 31
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 32 + _i
CLASSES = 33 + len(_MARKS)
_CLASS[_CLASS == 31 + len(_MARKS)] = CLASSES - 1
_CLASS[ord(_MARKS[-1])] = CLASSES - 2
#: Coarse classes for transitions: lower, upper, digit, blank, line end, sentence mark, other mark, non-ASCII.
_COARSE = np.full(256, 6, np.int64)
_COARSE[ord("a") : ord("z") + 1] = 0
_COARSE[ord("A") : ord("Z") + 1] = 1
_COARSE[ord("0") : ord("9") + 1] = 2
_COARSE[[0x20, 9, 11, 12]] = 3
_COARSE[[10, 13]] = 4
_COARSE[[ord(c) for c in ".,!?;:"]] = 5
_COARSE[0x80:] = 7
EXTRA = 12
FEATURES = CLASSES + 64 + EXTRA


@dataclass
class Passages:
    doc: np.ndarray
    x: np.ndarray


def passages(texts: pa.Array) -> Passages:
    """The passages of a slice and their statistics."""
    buf, off = B.flat(texts)
    sizes = np.diff(off)
    per = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.arange(len(sizes)), per)
    first = np.cumsum(per) - per
    n, total = len(doc), len(buf)
    starts = off[:-1][doc] + (np.arange(n) - first[doc]) * PASSAGE
    stops = np.minimum(starts + PASSAGE, off[1:][doc])
    of = np.repeat(np.arange(n), stops - starts)
    length = np.maximum(stops - starts, 1).astype(float)
    x = np.zeros((n, FEATURES))
    lines = np.bincount(of, weights=buf == 10, minlength=n) + 1
    x[:, CLASSES + 64 + 9] = np.log1p(length / lines) / 8  # also of a slice without any bytes
    if total:
        x[:, :CLASSES] = np.bincount(of * CLASSES + _CLASS[buf], minlength=n * CLASSES).reshape(n, CLASSES) / length[:, None]
        pair = _COARSE[buf[:-1]] * 8 + _COARSE[buf[1:]]
        within = of[:-1] == of[1:]  # no pair over a passage's end: the next byte may be another document's
        x[:, CLASSES : CLASSES + 64] = np.bincount((of[:-1] * 64 + pair)[within], minlength=n * 64).reshape(n, 64) / length[:, None]
        cut = np.unique(np.concatenate([off, starts]))
        ws, we, _ = B.runs(~B.SPACE[buf], cut)
        p = of[ws]
        h, _ = B.word_hashes(B.LOWER[buf], ws, we)
        words = np.maximum(np.bincount(p, minlength=n), 1).astype(float)
        size = (we - ws).astype(float)
        mean = np.bincount(p, weights=size, minlength=n) / words
        e = x[:, CLASSES + 64 :]
        e[:, 0] = mean / 10
        e[:, 1] = np.sqrt(np.maximum(np.bincount(p, weights=size * size, minlength=n) / words - mean * mean, 0)) / 10
        e[:, 2] = _distinct(p, h, n) / words
        pairs, pp = B.shingles(h, p, 2)
        e[:, 3] = _distinct(pp, pairs, n) / np.maximum(np.bincount(pp, minlength=n), 1)
        e[:, 4] = _top(p, h, n) / words
        upper = (buf >= 65) & (buf <= 90)
        e[:, 5] = np.bincount(p, weights=upper[ws], minlength=n) / words
        e[:, 6] = np.bincount(p, weights=upper[we - 1] & (we - ws > 1), minlength=n) / words
        e[:, 7] = np.bincount(p, weights=h_equal_next(h, p), minlength=n) / words
        e[:, 8] = np.bincount(p, weights=~B.LETTER[buf[we - 1]], minlength=n) / words
        e[:, 10] = np.bincount(p, weights=size <= 2, minlength=n) / words
        e[:, 11] = np.bincount(p, weights=size > 20, minlength=n) / words
    return Passages(doc, np.sqrt(x))


def _distinct(group: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return np.bincount(g, weights=new, minlength=n)


def _top(group: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How often the most frequent key of each group occurs."""
    out = np.zeros(n)
    if len(group):
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
        np.maximum.at(out, g[new], np.diff(np.append(new, len(g))))
    return out


def h_equal_next(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    same = np.zeros(len(h))
    if len(h) > 1:
        same[:-1] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
    return same


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def row_product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, column by column: unlike a blocked product, a row's last bits don't depend on the rows beside it."""
    out = np.zeros((len(x), w.shape[1]))
    for k in range(len(w)):
        out += x[:, k, None] * w[k]
    return out


@dataclass
class GatedAttention:
    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def _forward(self, x: np.ndarray, doc: np.ndarray, n: int, product=np.matmul) -> dict:
        p = self.p
        h = np.tanh(product(x, p["W"]) + p["b"])
        t, s = np.tanh(product(h, p["V"])), _sigmoid(product(h, p["U"]))
        e = np.clip(product(t * s, p["w"][:, None])[:, 0], -30, 30)
        a = np.exp(e)
        a /= np.bincount(doc, weights=a, minlength=n)[doc]
        z = np.stack([np.bincount(doc, weights=a * h[:, k], minlength=n) for k in range(h.shape[1])], 1)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(product(z, p["c"][:, None])[:, 0] + p["d"])}

    def score(self, bag: Passages, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Document scores and the passages' attention; both are functions of the text alone."""
        out = self._forward((bag.x - self.mean) / self.scale, bag.doc, n, row_product)
        return out["score"], out["a"]


def fit(texts: list[str], labels: list[int], hidden: int = 24, gate: int = 12, epochs: int = 40, rate: float = 0.004, l2: float = 1e-4, batch: int = 64) -> GatedAttention:
    """Adam on the log-loss of document labels; the order of the rows is fixed by a seed."""
    rng = np.random.default_rng(11)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": init(FEATURES, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.zeros(1)}
    if not texts:
        p["c"] = np.zeros(hidden)
        return GatedAttention(p, np.zeros(FEATURES), np.ones(FEATURES))
    y_all = np.asarray(labels, float)
    bags = [passages(pa.array(texts[i : i + batch], pa.string())) for i in range(0, len(texts), batch)]
    xs = np.concatenate([b.x for b in bags])
    model = GatedAttention(p, xs.mean(0), xs.std(0) + 1e-3)
    of = np.concatenate([b.doc + i * batch for i, b in enumerate(bags)])
    xs = (xs - model.mean) / model.scale
    begins = np.searchsorted(of, np.arange(len(texts) + 1))
    m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = np.sort(order[i : i + batch])
            take = np.concatenate([np.arange(begins[r], begins[r + 1]) for r in rows])
            x, doc, y = xs[take], np.repeat(np.arange(len(rows)), begins[rows + 1] - begins[rows]), y_all[rows]
            f = model._forward(x, doc, len(rows))
            dl = (f["score"] - y) / len(rows)
            dz = dl[:, None] * p["c"]
            da = (dz[doc] * f["h"]).sum(1)
            de = f["a"] * (da - np.bincount(doc, weights=f["a"] * da, minlength=len(rows))[doc])
            dts = de[:, None] * p["w"]
            dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
            dh = (f["a"][:, None] * dz[doc] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
            g = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}
            step += 1
            for k in p:
                grad = g[k] + l2 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score(documents: DataFrame, model: GatedAttention) -> DataFrame:
    """doc_id, score, n_passages, top_passage (0-based, the one with the most attention) and its attention."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers, whatever the input

    def work(part):
        n = part.num_rows
        bag = passages(part.column("text"))
        docs, a = shared.value.score(bag, n)
        first = np.searchsorted(bag.doc, np.arange(n))
        order = np.lexsort((np.arange(len(a)), -a, bag.doc))
        best = order[first]
        yield {"doc_id": part.column("doc_id"), "score": docs, "n_passages": np.bincount(bag.doc, minlength=n).astype(np.int64), "top_passage": (best - first).astype(np.int64), "top_attention": a[best]}

    kind = dict(documents.dtypes)["doc_id"]
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, score double, n_passages long, top_passage long, top_attention double", work)
