"""Language-model scoring by a weighted backoff automaton over trigram counts of the corpus.

Tokens: words divided by white space (A-Z lower-cased), then an end. States are the root, the start, every training word v, and the word
pairs (u, v) that have arcs of their own. Arcs and failure arcs:

- root: an arc for each word, p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); unknown words lead back to the root;
- v: an arc for each word w seen after v, p(w | v) = (1 - g) c(v, w) / c(v) + g p(w); failure to the root with weight g;
- (u, v): an arc for each w kept after (u, v), p(w | u, v) = (1 - g) c(u, v, w) / D + g p(w | v); failure to v with weight g.
  After pairs seen fewer than `DENSE` times the words seen twice or more are kept, after the others all of them; D sums the kept counts.

So the probabilities after each state sum to 1 (interpolated smoothing). g is estimated by leaving one out: the share of training tokens whose
arc would be gone without themselves, over all states of one length whose counts have the same binary order of magnitude. An arc leads
to the longest suffix that is a state. A text is traversed from left to right: the state is carried, failure arcs are taken as long
as it has no arc for the token, and log10 weights add up. Long texts are traversed in pieces side by side, each from two
tokens earlier, which is enough to be in the right state.

No table of n-grams is gathered or broadcast. Documents are packed into blocks (blocks.py); a block asks the distributed counts for its
distinct words and pairs, then for its triples whose two pairs were seen twice or more (no other can be kept), and builds the
part of the automaton that its texts can visit. Counting and asking are the same message, so all counts cover all training texts. The triples of
a pair that is not dense meet in one bucket, fewer than `DENSE` occurrences; those of dense pairs are dealt out one by one. To the
driver come N, V and 4 * 64 sums. Words are told apart by 64-bit hashes, pairs by 56 bits.

Defined results: a null text is an empty text, one end; each input row gives one row; without training texts N = V = 0 and the unigrams are
uniform; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .blocks import BLOCK_BYTES, answers, ask, by_part, documents_of, number_of_blocks, packed, row, squeeze, unpack_sorted
from .shared import materialise

END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
ALPHA = 0.1
DENSE = 1 << 16
PIECE = 256
BINS = 64
_WORDS, _PAIRS, _TRIPLES, _MASS, _STAT = 1, 2, 3, 4, 9
_BESIDE = {_WORDS: (np.uint32,), _PAIRS: (np.uint32,), _TRIPLES: (np.uint32, np.uint8, np.uint32)}
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_PAIR_BITS = np.uint64(0xFFFFFFFFFFFFFF00)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with each text's end, and the texts' first tokens."""
    buf, off = B.flat(table["text"])
    ws, we, doc = B.runs(~B.SPACE[buf] if len(buf) else np.zeros(0, bool), off)
    h, _ = B.word_hashes(B.LOWER[buf], ws, we)
    n = len(off) - 1
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.cumsum(counts + 1) - (counts + 1)
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, first


def _shifted(a: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value of the token before; `start` for first tokens."""
    out = np.empty_like(a)
    out[1:] = a[:-1]
    out[first] = start
    return out


def _distinct(h: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, inverse = np.unique(h, return_inverse=True)
    return keys, inverse.astype(np.int32), np.bincount(inverse[train], minlength=len(keys)).astype(np.uint32)


def _chain(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return B.mix(before * B.FNV_PRIME + h)


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.uint8)


def _binned(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.bincount(_bin(counts), weights=weights, minlength=BINS)


class _Block:
    """What a block knows: tokens and pairs; their counts after the first answers."""

    def __init__(self, held: list, dense: int, counted: bool = True):
        table = documents_of(held)
        self.ids = table["doc_id"]
        self.h, self.first = _tokens(table)
        lengths = np.diff(np.append(self.first, len(self.h)))
        self.train = np.repeat(table["_train"].to_numpy().astype(bool), lengths)
        del table
        self.words, self.of, self.own = _distinct(self.h, self.train)
        self.pair = _chain(_shifted(self.h, self.first, START), self.h) & _PAIR_BITS
        self.pairs, self.pair_of, self.pair_own = _distinct(self.pair, self.train)
        if not counted:
            return
        self.c = answers(held, _WORDS, np.uint64)  # of distinct words
        got = answers(held, _PAIRS, np.uint64)
        self.c2, self.here = got >> np.uint64(1), (got & np.uint64(1)) > 0  # of distinct pairs; whether this block accounts for it
        self.ends = self.c[np.searchsorted(self.words, END)] if len(self.words) else np.uint64(0)
        one = np.zeros(len(self.pairs), np.int32)  # a place of each distinct pair
        one[self.pair_of] = np.arange(len(self.h))
        self.second = self.of[one]
        self.first_word = _shifted(self.of, self.first, -1)[one]  # -1: the start
        self.u = np.where(self.first_word >= 0, self.c[self.first_word], self.ends) if len(one) else np.zeros(0, np.uint64)
        # triples: places whose history is a pair seen twice or more
        inner = np.ones(len(self.h), bool)
        inner[self.first] = False
        at = np.flatnonzero(inner).astype(np.int32)
        at = at[self.c2[self.pair_of[at - 1]] >= 2]
        history, last = self.pair_of[at - 1], self.c2[self.pair_of[at]]
        thick = self.c2[history] >= dense
        kept = np.where(thick, last >= 1, last >= 2)
        asked = np.zeros(len(self.pairs), bool)
        asked[history[kept]] = True
        lone = np.flatnonzero(np.bincount(history[~thick], minlength=len(self.pairs)).astype(bool) & ~asked)  # histories that ask for their mass alone
        self.at, self.history = at[kept], history[kept]
        whole = _chain(self.pair[self.at - 1], self.h[self.at])
        key = np.where(thick[kept], whole, (self.pairs[self.history] & _HIGH) | (whole & _LOW))
        every = np.concatenate([key, self.pairs[lone] & _HIGH])
        self.triples, of, self.triple_own = _distinct(every, np.concatenate([self.train[self.at], np.zeros(len(lone), bool)]))
        self.triple_of = of[: len(key)]
        self.triple_history = np.zeros(len(self.triples), np.int32)
        self.triple_history[of] = np.concatenate([self.history, lone])

    def stats(self) -> np.ndarray:
        """Of the pairs that this block accounts for: once-seen and all tokens by the count of the first word, tokens that follow by the pair's."""
        mine = self.here & (self.c2 > 0)
        c2, u = self.c2[mine].astype(np.float64), self.u[mine]
        goes_on = c2 * (self.words[self.second[mine]] != END)
        return np.concatenate([_binned(u, c2 == 1), _binned(u, c2), _binned(self.c2[mine], goes_on), np.zeros(BINS)]).astype(np.uint64)


@dataclass
class Automaton:
    """States 0 (root), words, the start, pairs. Arcs by number: source, target, log10 weight; failures by state. `arcs`: for each token the
    numbers of the arcs with its label, from pairs, words and the root (-1: none)."""

    start: int
    source: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    failure: np.ndarray
    failure_weight: np.ndarray
    arcs: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, b: _Block, c3: np.ndarray, mass: np.ndarray, novel: tuple[np.ndarray, np.ndarray], rest: float, dense: int) -> Automaton:
        c, c2, u = (x.astype(np.float64) for x in (b.c, b.c2, b.u))
        n_words, n_pairs = len(b.words), len(b.pairs)
        start = 1 + n_words
        word_state = np.append(np.where(c > 0, 1 + np.arange(n_words), 0), start).astype(np.int32)  # the last: of the start, index -1
        kept = np.zeros(n_pairs)
        kept[b.triple_history] = mass
        thick = b.c2 >= dense
        kept[thick] = c2[thick]
        real = (c2 >= 2) & (kept > 0) & (b.words[b.second] != END)
        pair_state = np.where(real, start + np.cumsum(real), 0).astype(np.int32)
        g1 = np.where(u > 0, novel[0][_bin(b.u)], 1.0)
        g2 = novel[1][_bin(b.c2)]
        root = (c + ALPHA) / rest
        seen = c2 > 0
        second = np.where(seen, (1 - g1) * c2 / np.maximum(u, 1) + g1 * root[b.second], 1.0)
        arc_target = np.where(real, pair_state, word_state[b.second])
        mine = b.triple_history
        last = np.zeros(len(b.triples), np.int32)  # the pair of a triple's last two words
        last[b.triple_of] = b.pair_of[b.at]
        third = np.where(c3 > 0, (1 - g2[mine]) * c3 / np.maximum(kept[mine], 1) + g2[mine] * second[last], 1.0)
        failure = np.zeros(start + 1 + int(real.sum()), np.int32)
        weight = np.zeros(len(failure))
        known = np.flatnonzero(c > 0)
        weight[1 + known] = np.log10(novel[0][_bin(b.c[known])])
        if b.ends > 0:
            weight[start] = np.log10(novel[0][_bin(np.array([b.ends]))[0]])
        failure[pair_state[real]] = word_state[b.second[real]]
        weight[pair_state[real]] = np.log10(g2[real])
        arc3 = np.full(len(b.h), -1, np.int32)
        arc3[b.at] = np.where(c3[b.triple_of] > 0, b.triple_of, -1)
        arc2 = np.where(seen[b.pair_of], np.int32(len(b.triples)) + b.pair_of, np.int32(-1))
        arc1 = np.int32(len(b.triples) + n_pairs) + b.of
        return cls(
            start, np.concatenate([pair_state[mine], word_state[b.first_word], np.zeros(n_words, np.int32)]), np.concatenate([arc_target[last], arc_target, word_state[:-1]]),
            np.log10(np.concatenate([third, second, root])), failure, weight, (arc3, arc2, arc1),
        )

    def traverse(self, first: np.ndarray, n_tokens: int, piece: int = PIECE) -> np.ndarray:
        """The log10 probability of each text, from left to right; all pieces of texts take their steps together."""
        sizes = np.diff(np.append(first, n_tokens))
        cuts = -(-sizes // piece)
        doc = np.repeat(np.arange(len(first)), cuts)
        within = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * piece
        warm = np.minimum(within, 2)  # tokens read ahead to be in the right state
        begin, size = first[doc] + within - warm, np.minimum(sizes[doc] - within, piece) + warm
        state = np.where(within == warm, self.start, 0).astype(np.int32)
        order = np.argsort(-size, kind="stable")
        begin, size, warm, doc, state = begin[order], size[order], warm[order], doc[order], state[order]
        total = np.zeros(len(doc))
        for step in range(int(size[0]) if len(size) else 0):
            n = np.searchsorted(-size, -step, "left")  # pieces longer than this step
            at, s = begin[:n] + step, state[:n]
            arc, cost = np.full(n, -1, np.int64), np.zeros(n)
            for labelled in self.arcs:
                a = labelled[at]
                hit = (arc < 0) & (a >= 0) & (self.source[a] == s)
                arc = np.where(hit, a, arc)
                if labelled is self.arcs[2]:
                    break
                fails = (arc < 0) & ((s > self.start) if labelled is self.arcs[0] else (s > 0))
                cost += np.where(fails, self.failure_weight[s], 0.0)
                s = np.where(fails, self.failure[s], s)
            state[:n] = self.target[arc]
            total[:n] += np.where(step >= warm[:n], cost + self.weight[arc], 0.0)
        return np.bincount(doc, weights=total, minlength=len(first))


def _merge(bucket: int, held: list, dense_bin: int):
    """Adds up the counts of a bucket and answers every block; also the sums that the model needs of the whole table."""
    stat = [np.frombuffer(blob, np.uint64) for _, k, blob in held if k == _STAT]
    sums = np.sum(stat, axis=0, dtype=np.uint64) if stat else np.zeros(4 * BINS, np.uint64)
    for kind in (_WORDS, _PAIRS, _TRIPLES):
        asked = [(block, unpack_sorted(blob, *_BESIDE[kind])) for block, k, blob in held if k == kind]
        if not asked:
            continue
        keys, place, inverse = np.unique(np.concatenate([a[0] for _, a in asked]), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[1] for _, a in asked]), minlength=len(keys)).astype(np.uint64)
        replies = {kind: total[inverse]}
        if kind == _WORDS:
            sums[:2] = total.sum(), (total > 0).sum()
        elif kind == _PAIRS:
            replies[kind] = total[inverse] << np.uint64(1) | (place[inverse] == np.arange(len(inverse))).astype(np.uint64)
        else:
            bins, low = (np.concatenate([a[i] for _, a in asked])[place] for i in (2, 3))
            thick = bins >= dense_bin
            kept = np.where(thick | (total >= 2), total, 0).astype(np.uint64)
            _, history = np.unique((keys & _HIGH) | low, return_inverse=True)
            mass = np.bincount(history, weights=np.where(thick, 0, kept))[history].astype(np.uint64)
            stays = np.where(total >= np.where(thick, 2, 3), total, 0)  # also without one of its tokens
            sums[3 * BINS :] += np.bincount(bins, weights=stays, minlength=BINS).astype(np.uint64)
            replies = {_TRIPLES: kept[inverse], _MASS: mass[inverse]}
        for name, values in replies.items():
            at = 0
            for block, a in asked:
                yield row(block, bucket, name, squeeze(values[at : at + len(a[0])]))
                at += len(a[0])
    yield row(-1, bucket, _STAT, sums.tobytes())


def _sums(replies: DataFrame) -> np.ndarray:
    """The buckets' sums, added up by Spark."""

    def run(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                v = np.frombuffer(blob, np.uint64)
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(v)), pa.int32()), "v": pa.array(v.astype(np.int64))})

    rows = replies.where(F.col("kind") == _STAT).mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(4 * BINS)
    for r in rows:
        out[r.i] = float(r.v)
    return out


def score(documents: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES, dense: int = DENSE, piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; `train` picks the rows whose texts are counted, `dense` is a power of two."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("_train"))
    id_kind = dict(docs.dtypes)["doc_id"]
    n = number_of_blocks(docs, block_bytes)
    dense_bin = dense.bit_length()
    blocks = packed(docs, n)

    def ask_pairs(block, held):
        b = _Block(held, dense, counted=False)
        yield from ask(block, _WORDS, n, b.words, b.own)
        yield from ask(block, _PAIRS, n, b.pairs, b.pair_own)

    def ask_triples(block, held):
        b = _Block(held, dense)
        history = b.pairs[b.triple_history]
        yield from ask(block, _TRIPLES, n, b.triples, b.triple_own, _bin(b.c2[b.triple_history]), (history & _LOW).astype(np.uint32))
        yield row(block, block, _STAT, b.stats().tobytes())

    def merge(bucket, held):
        yield from _merge(bucket, held, dense_bin)

    pairs = materialise(by_part(by_part(blocks, n, ask_pairs), n, merge), "pairs")
    tokens, types = _sums(pairs)[:2]
    counted = blocks.union(pairs.where(F.col("kind") != _STAT))
    triples = materialise(by_part(by_part(counted, n, ask_triples), n, merge), "triples")
    single, every, follows, stays = _sums(triples).reshape(4, BINS)
    novel = tuple(np.clip(x, 1e-4, 0.9999) for x in (single / np.maximum(every, 1), 1 - stays / np.maximum(follows, 1)))
    rest = tokens + ALPHA * (types + 1)

    def work(block, held):
        b = _Block(held, dense)
        a = Automaton.of(b, answers(held, _TRIPLES, np.uint64), answers(held, _MASS, np.uint64), novel, rest, dense)
        root = np.log10((b.c + ALPHA) / rest)[b.of]
        yield {
            "doc_id": b.ids.combine_chunks(), "n_tokens": np.diff(np.append(b.first, len(b.h))), "n_known": np.add.reduceat((b.c > 0)[b.of], b.first, dtype=np.int64),
            "base_score": np.add.reduceat(root, b.first), "score": a.traverse(b.first, len(b.h), piece),
        }

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def make(rows):
        return pa.RecordBatch.from_arrays([c if isinstance(c := rows[0][x], pa.Array) else pa.array(c) for x in names], names=names)

    everything = counted.union(triples.where(F.col("kind") != _STAT))
    out = by_part(everything, n, work, f"doc_id {id_kind}, n_tokens long, n_known long, base_score double, score double", make)
    return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
