"""Token counts under a unigram model, by dynamic programming over a trie.

The vocabulary comes from a sentencepiece model file, whose path is a parameter. Such BPE files carry merge ranks, not probabilities:
a piece of rank r gets the Zipf log-probability -log(r + 1) - log(H), H the harmonic number of the vocabulary's size. The best
segmentation of a pre-token (a run of space marks with what follows) maximises the sum of its pieces' log-probabilities; a
character without piece costs its UTF-8 bytes, one token each, at FALLBACK below the rarest piece.

The distinct pre-tokens of a slice are put in a trie, level by level: all prefixes of d characters at once. A node keeps the best
forward score of its prefix and the number of tokens that reach it, computed once for all pre-tokens below it; terminal nodes hold the
counts. Pre-tokens longer than `LONG` characters are treated alike, one by one. Equal scores are settled for fewer tokens.

Defined results: null and empty texts have no tokens; each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import FNV_PRIME, mix
from .pieces import CACHE_WORDS, Vocabulary, _split
from .shared import map_slices

FALLBACK = 10.0
LONG = 64


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(h * FNV_PRIME + c.astype(np.uint64) + np.uint64(1))


@dataclass
class Unigram:
    """Reversed pieces by hash: log-probabilities; and the hashes of all their beginnings, to stop early."""

    keys: np.ndarray
    logs: np.ndarray
    parts: np.ndarray
    widest: int
    floor: float
    _cache: dict = field(default_factory=dict)

    @classmethod
    def of(cls, v: Vocabulary) -> Unigram:
        ranked = sorted((-float(v.scores[i]), i) for i, k in enumerate(v.kinds) if k == 1)
        total = np.log(np.sum(1 / np.arange(1, len(ranked) + 1)))
        pieces = {v.strings[i]: -np.log(r + 1) - total for r, (_, i) in enumerate(ranked)}
        widest = max(map(len, pieces))
        parts, ends = set(), {}
        for s, log in pieces.items():
            h = np.zeros(1, np.uint64)
            for c in reversed(s):
                h = _step(h, np.array([ord(c)]))
                parts.add(int(h[0]))
            ends[int(h[0])] = log
        keys = np.array(sorted(ends), np.uint64)
        return cls(keys, np.array([ends[int(k)] for k in keys]), np.array(sorted(parts), np.uint64), widest, min(pieces.values()) - FALLBACK)

    def vocabulary_scores(self, v: Vocabulary) -> dict[str, float]:
        ranked = sorted((-float(v.scores[i]), i) for i, k in enumerate(v.kinds) if k == 1)
        total = np.log(np.sum(1 / np.arange(1, len(ranked) + 1)))
        return {v.strings[i]: float(-np.log(r + 1) - total) for r, (_, i) in enumerate(ranked)}

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each of the distinct words."""
        out = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._trie([words[i]], sizes[i : i + 1])[0]
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            out[short] = self._trie([words[i] for i in short], sizes[short])
        return out

    def _trie(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)  # the node each word has reached; 0 is the root
        live = np.flatnonzero(sizes > 0)
        char, up = [np.zeros(1, np.uint32)], [np.zeros(1, np.int64)]
        best, n_tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        chars, ups, bests, counts = char[0], up[0], best[0], n_tokens[0]
        depth = 0
        room = 1
        while len(live):
            key = node[live].astype(np.uint64) << np.uint64(21) | flat[begin[live] + depth].astype(np.uint64)
            new, inverse = np.unique(key, return_inverse=True)
            parent, c = (new >> np.uint64(21)).astype(np.int64), (new & np.uint64((1 << 21) - 1)).astype(np.uint32)
            at = room + np.arange(len(new))
            room += len(new)
            if room > len(chars):
                more = max(room, 2 * len(chars))
                chars, ups, bests, counts = (np.concatenate([a, np.zeros(more - len(a), a.dtype)]) for a in (chars, ups, bests, counts))
            chars[at], ups[at] = c, parent
            wide = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            score, tokens = bests[parent] + self.floor * wide, counts[parent] + wide
            todo, h, spot = np.arange(len(new)), np.zeros(len(new), np.uint64), at.copy()
            for _ in range(min(self.widest, depth + 1)):
                h = _step(h, chars[spot])
                spot = ups[spot]
                found = np.minimum(np.searchsorted(self.parts, h), len(self.parts) - 1)
                go = self.parts[found] == h
                if not go.any():
                    break
                todo, h, spot = todo[go], h[go], spot[go]
                found = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                piece = self.keys[found] == h
                s, t, i = bests[spot] + self.logs[found], counts[spot] + 1, todo
                better = piece & ((s > score[i]) | (s == score[i]) & (t < tokens[i]))
                score[i[better]], tokens[i[better]] = s[better], t[better]
            bests[at], counts[at] = score, tokens
            node[live] = at[inverse]
            depth += 1
            ended = sizes[live] == depth
            out[live[ended]] = counts[node[live[ended]]]
            live = live[~ended]
        return out

    def texts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        split = [_split(t) for t in texts]
        cache, old = self._cache.setdefault("new", {}), self._cache.setdefault("old", {})
        if len(cache) > CACHE_WORDS:  # two generations of bounded size: words not seen during a whole one go
            cache, old = self._cache["new"], self._cache["old"] = {}, cache
        fresh = []
        for w in set().union(*split).difference(cache):
            if (hit := old.get(w)) is None:
                fresh.append(w)
            else:
                cache[w] = hit
        cache.update(zip(fresh, self.counts(fresh).tolist()))
        return [sum(map(cache.__getitem__, ws)) for ws in split], [len(ws) for ws in split]


def count(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens."""
    shared = documents.sparkSession.sparkContext.broadcast(Unigram.of(Vocabulary.read(path)))  # the vocabulary, whatever the input

    def work(part):
        n, words = shared.value.texts([t or "" for t in part.column("text").to_pylist()])
        yield {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "n_pretokens": pa.array(words, pa.int64())}

    kind = dict(documents.dtypes)["doc_id"]
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, n_pretokens long", work, finish=lambda: shared.value._cache.clear())
