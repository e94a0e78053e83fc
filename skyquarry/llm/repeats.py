"""Removal of byte strings that repeat anywhere in the corpus, by local enhanced suffix arrays.

A string of `LENGTH` bytes (a window) is repeated if it starts at two places or more, in one document or several. All bytes of repeated
windows go; matches don't cross documents.

Windows that are equal share their minimizer: the leftmost of their `GRAM`-byte runs with the least hash. The successive windows of a document
with the same minimizer form a context, the bytes that they cover. Only contexts with equal minimizers can share windows.

1. Blocks (blocks.py) ask for the counts of their contexts and minimizers. A context that occurs twice is repeated as a whole; one whose
   minimizer has no other context needs nothing more.
2. The others, mostly at the edges of repeated passages, meet by minimizer, each distinct context once. There the suffixes that can
   start a window are sorted into an enhanced suffix array, and a stack scan of its common-prefix intervals reports the maximal
   repeats: intervals of LENGTH bytes or more whose occurrences are preceded by different bytes, with all their occurrences. A minimizer
   with more than `HOT` contexts is not gathered: its windows ask for their own counts instead, which is as exact.
3. Blocks mark the answers, join overlapping spans, and cut them out.

Contexts and windows are told apart by 64-bit hashes where only counts travel. Defined results: a null text is an empty text; texts shorter
than LENGTH lose nothing; each input row gives one row (repeated rows are repeats of each other); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .blocks import BLOCK_BYTES, answers, ask, bucket_bounds, by_part, documents_of, number_of_blocks, packed, row, squeeze, unpack_sorted, unsqueeze
from .shared import materialise

LENGTH, GRAM, HOT = 200, 50, 512
CHUNK = 1 << 20
SORT_WINDOWS = 100_000
_CONTEXTS, _GRAMS, _TEXTS, _WINDOWS, _PLACES = 1, 2, 3, 4, 5
_PRIME = 0x9E3779B97F4A7C15 | 1


def rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` bytes: runs of 1, 2, 4, ... bytes are put together."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, out, done = B.mix(buf.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while True:
        if size & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(_PRIME, width, 1 << 64)) + piece
            done += width
        if done == size:
            return B.mix(out)
        part = part[:-width] * np.uint64(pow(_PRIME, width, 1 << 64)) + part[width:]
        width *= 2


@dataclass
class Contexts:
    """Contexts of a flat buffer: first window, number of windows, minimizer's place."""

    start: np.ndarray
    windows: np.ndarray
    place: np.ndarray


def contexts(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Contexts:
    """The contexts of all texts, in order."""
    width = length - gram + 1
    starts, windows, places = [], [], []
    begin = 0
    while begin < len(off) - 1:  # whole texts of about CHUNK bytes, or a part of one longer text
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + CHUNK, "right")) - 1)
        low, high = int(off[begin]), int(off[end])
        for at in range(low, max(high - length + 1, low), CHUNK if end == begin + 1 else high - low + 1):
            stop = min(at + CHUNK + length - 1, high) if end == begin + 1 else high
            h = rolling(buf[at:stop], gram)
            if len(h) < width:
                continue
            least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # the hash's upper bits, then the place: leftmost of equals
            w = 1
            while w * 2 <= width:
                least = np.minimum(least[:-w], least[w:])
                w *= 2
            if width > w:
                least = np.minimum(least[: len(h) - width + 1], least[width - w :])
            place = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + at
            s = np.arange(at, at + len(place))
            text = np.searchsorted(off, s, "right") - 1
            good = s + length <= off[text + 1]
            new = np.ones(len(s), bool)
            new[1:] = (place[1:] != place[:-1]) | ~good[:-1]
            new &= good
            first = np.flatnonzero(new)
            run = np.add.reduceat(good, first) if len(first) else first
            starts.append(s[first])
            windows.append(run)
            places.append(place[first])
        begin = end
    if not starts:
        z = np.zeros(0, np.int64)
        return Contexts(z, z, z)
    return Contexts(np.concatenate(starts), np.concatenate(windows).astype(np.int64), np.concatenate(places))


def _hash_at(buf: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` bytes at given places."""
    h = np.zeros(len(places), np.uint64)
    for j in range(size):
        h = (h ^ buf[places + j]) * B.FNV_PRIME
    return B.mix(h)


def maximal_repeats(texts: list[bytes], starts: list[tuple[int, int]] | None = None, length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeats of `length` bytes or more: (bytes, [(text, place)]), with all occurrences.

    starts: for each text the range of places that may begin an occurrence (default: all). The suffixes there are sorted, and one scan over
    the common prefixes of neighbours keeps a stack of open intervals; a closed interval is reported if its occurrences can't all
    be extended to the left by the same byte (the edge of the range counts as a byte of its own)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    low, high = np.array(starts or [(0, len(t)) for t in texts], np.int64).reshape(-1, 2).T
    n = np.maximum(np.minimum(high, lengths - length + 1) - low, 0)
    if n.sum() < 2:
        return []
    base = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(texts)), n)
    at = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size, flat = lengths[of] - at, base[of] + at
    widest = int(size.max())
    data = np.frombuffer(b"".join(texts) + bytes(widest), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, widest)[flat]
    rows[np.arange(widest) >= size[:, None]] = 0  # a suffix ends with its text
    order = np.argsort(rows.view(f"S{widest}").ravel(), kind="stable")
    rows, size, flat, of, at = rows[order], size[order], flat[order], of[order], at[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), widest)
    lcp = np.minimum(same, np.minimum(size[1:], size[:-1]))
    edge = at == low[of]
    left = np.where(edge, -1 - np.arange(len(of)), data[np.maximum(flat - 1, 0)].astype(np.int64))
    # runs of neighbours with long common prefixes; the scan stays inside them
    long = lcp >= length
    begins = np.flatnonzero(long & ~np.append(False, long[:-1]))
    ends = np.flatnonzero(long & ~np.append(long[1:], False)) + 1
    out = []
    lcp_list, left_list = lcp.tolist(), left.tolist()
    for a, b in zip(begins.tolist(), ends.tolist()):
        if b == a + 1:
            if left_list[a] != left_list[b]:
                out.append((lcp_list[a], a, b))
            continue
        stack: list[list[int]] = []  # [common prefix, first suffix, the one byte to the left or none]
        for i in range(a, b + 1):
            now = lcp_list[i] if i < b else 0
            begin, byte = i, left_list[i]
            while stack and stack[-1][0] > now:
                common, begin, seen = stack.pop()
                seen = seen if seen == byte else None
                if seen is None:
                    out.append((common, begin, i))
                byte = seen
            if stack and stack[-1][0] == now:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            elif now:
                stack.append([now, begin, byte])
            if stack and stack[-1][2] is None:
                byte = None
    return [(common, [(int(of[i]), int(at[i])) for i in range(a, b + 1)]) for common, a, b in out]


class _Block:
    def __init__(self, held: list, known: bool):
        table = documents_of(held)
        self.ids = table["doc_id"]
        self.buf, self.off = B.flat(table["text"])
        if known:
            blob = next(b for _, k, b in held if k == _PLACES)
            a = unsqueeze(blob, np.uint32).reshape(3, -1).astype(np.int64)
            self.ctx = Contexts(np.cumsum(a[0]), a[1], np.cumsum(a[0]) + a[2])
        else:
            self.ctx = contexts(self.buf, self.off)
        c = self.ctx
        self.gram = _hash_at(self.buf, c.place, GRAM) if len(c.place) else np.zeros(0, np.uint64)
        view, digest = memoryview(self.buf), xxhash.xxh3_64_intdigest
        text = np.fromiter((digest(view[s : s + n + LENGTH - 1], p - s) for s, n, p in zip(c.start.tolist(), c.windows.tolist(), c.place.tolist())), np.uint64, len(c.start))
        self.key = B.mix(self.gram ^ B.mix(text + c.windows.astype(np.uint64)))
        self.keys, self.first, self.of = np.unique(self.key, return_index=True, return_inverse=True)
        self.own = np.minimum(np.bincount(self.of, minlength=len(self.keys)), 2).astype(np.uint8)
        self.grams, self.gram_of = np.unique(self.gram[self.first], return_inverse=True)  # of distinct contexts
        self.gram_own = np.bincount(self.gram_of, minlength=len(self.grams)).astype(np.uint32)

    def places(self) -> bytes:
        c = self.ctx
        return squeeze(np.concatenate([np.diff(c.start, prepend=0), c.windows, c.place - c.start]).astype(np.uint32))

    def read(self, held: list, hot: int) -> None:
        """After the first answers: which distinct contexts are repeated as a whole, this block's to send, or beside others."""
        got = answers(held, _CONTEXTS, np.uint32)
        total = answers(held, _GRAMS, np.uint32)[self.gram_of] if len(self.keys) else np.zeros(0, np.uint32)
        self.twice, self.send = (got & 2) > 0, (got & 1) > 0
        self.mixed = total > got >> 2
        self.hot = self.mixed & (total > hot)
        self.meet = np.flatnonzero(self.mixed & ~self.hot & self.send)
        self.alone = np.flatnonzero(self.hot & self.send)

    def windows_of(self, distinct: np.ndarray) -> np.ndarray:
        """The places of all windows of distinct contexts."""
        i = self.first[distinct]
        n = self.ctx.windows[i]
        return np.repeat(self.ctx.start[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _merge(bucket: int, held: list):
    """Counts contexts (who holds them, how often) and minimizers (how many contexts have them)."""
    for kind in (_CONTEXTS, _GRAMS):
        asked = [(block, unpack_sorted(blob, np.uint8 if kind == _CONTEXTS else np.uint32)) for block, k, blob in held if k == kind]
        if not asked:
            continue
        keys, first, inverse = np.unique(np.concatenate([a[0] for _, a in asked]), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[1] for _, a in asked]), minlength=len(keys)).astype(np.int64)
        holders = np.bincount(inverse, minlength=len(keys))
        at = 0
        for block, a in asked:
            mine = inverse[at : at + len(a[0])]
            if kind == _CONTEXTS:
                here = first[mine] == np.arange(at, at + len(mine))
                out = np.minimum(holders[mine], (1 << 30) - 1) << 2 | (total[mine] > 1) << 1 | here
            else:
                out = np.minimum(total[mine], (1 << 32) - 1)
            yield row(block, bucket, kind, squeeze(out.astype(np.uint32)))
            at += len(mine)


def _settle(bucket: int, held: list):
    """Finds the repeated windows of contexts that meet here, and counts windows that ask for themselves."""
    import pickle

    asked = [(block, unpack_sorted(blob, np.uint8)) for block, k, blob in held if k == _WINDOWS]
    if asked:
        keys, inverse = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
        twice = np.bincount(inverse, weights=np.concatenate([a[1] for _, a in asked]), minlength=len(keys)) > 1
        at = 0
        for block, a in asked:
            yield row(block, bucket, _WINDOWS, squeeze(twice[inverse[at : at + len(a[0])]].astype(np.uint8)))
            at += len(a[0])
    items = []
    for block, k, blob in held:
        if k == _TEXTS:
            gram, which, sizes, data = pickle.loads(blob)
            body, at = pa.decompress(data, decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True), 0
            for g, w, n in zip(gram.tolist(), which.tolist(), sizes.tolist()):
                items.append((g, block, w, body[at : at + n]))
                at += n
    items.sort(key=lambda x: x[:3])
    found: dict[int, list[tuple[int, int, int]]] = {}
    groups, begin = [], 0
    for i in range(1, len(items) + 1):
        if i == len(items) or items[i][0] != items[begin][0]:
            if i > begin + 1:
                groups.append((begin, i))
            begin = i
    i = 0
    while i < len(groups):  # several minimizers are sorted together, as far as their windows stay few
        batch, windows = [], 0
        while i < len(groups) and (not batch or windows < SORT_WINDOWS):
            part = items[groups[i][0] : groups[i][1]]
            batch += part
            windows += sum(len(x[3]) - LENGTH + 1 for x in part)
            i += 1
        for common, places in maximal_repeats([x[3] for x in batch]):
            for t, s in places:
                found.setdefault(batch[t][1], []).append((batch[t][2], s, s + common - LENGTH + 1))
    for block, ranges in sorted(found.items()):
        yield row(block, bucket, _TEXTS, squeeze(np.array(ranges, np.uint32).T.copy().ravel()))


def remove(documents: DataFrame, spans: bool = False, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; spans: also removed, array<struct<start, stop>> in bytes."""
    import pickle

    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_kind = dict(docs.dtypes)["doc_id"]
    n = number_of_blocks(docs, block_bytes)
    blocks = packed(docs, n)

    def ask_contexts(block, held):
        b = _Block(held, False)
        yield from ask(block, _CONTEXTS, n, b.keys, b.own)
        yield from ask(block, _GRAMS, n, b.grams, b.gram_own)
        yield row(-1 - block, 0, _PLACES, b.places())

    def merge(bucket, held):
        if bucket < 0:
            yield row(-1 - bucket, 0, _PLACES, held[0][2])
        else:
            yield from _merge(bucket, held)

    first = materialise(by_part(by_part(blocks, n, ask_contexts), n, merge), "contexts")

    def ask_windows(block, held):
        b = _Block(held, True)
        b.read(held, hot)
        gram = b.grams[b.gram_of[b.meet]]
        order = np.argsort(gram, kind="stable")
        gram, which = gram[order], b.meet[order]
        buckets, cuts = bucket_bounds(gram, n)
        view = memoryview(b.buf)
        for bucket, i, j in zip(buckets.tolist(), cuts.tolist(), cuts[1:].tolist()):
            s = b.ctx.start[b.first[which[i:j]]]
            sizes = b.ctx.windows[b.first[which[i:j]]] + LENGTH - 1
            data = b"".join(view[x : x + y] for x, y in zip(s.tolist(), sizes.tolist()))
            yield row(bucket, block, _TEXTS, pickle.dumps((gram[i:j], which[i:j].astype(np.uint32), sizes.astype(np.uint32), pa.compress(data, codec="zstd", asbytes=True))))
        if len(b.alone):
            keys, counts = np.unique(_hash_at(b.buf, b.windows_of(b.alone), LENGTH), return_counts=True)
            yield from ask(block, _WINDOWS, n, keys, np.minimum(counts, 2).astype(np.uint8))

    second = materialise(by_part(by_part(blocks.union(first), n, ask_windows), n, _settle), "windows")

    def cut(block, held):
        mine = [h for h in held if h[1] in (_CONTEXTS, _GRAMS, _PLACES) or h[1] < 0]
        b = _Block(mine, True)
        b.read(mine, hot)
        c = b.ctx
        marks = np.zeros(len(b.buf) + 1, np.int64)  # +1 where a removed stretch begins, -1 where it ends

        def mark(begin, stop):
            np.add.at(marks, begin, 1)
            np.add.at(marks, stop, -1)

        whole = np.flatnonzero(b.twice[b.of]) if len(b.of) else np.zeros(0, np.int64)
        mark(c.start[whole], c.start[whole] + c.windows[whole] + LENGTH - 1)
        for _, k, blob in held:
            if k == _TEXTS:
                which, low, high = unsqueeze(blob, np.uint32).reshape(3, -1).astype(np.int64)
                s = c.start[b.first[which]]  # contexts that occur once here; those that occur twice are marked already
                mark(s + low, s + high + LENGTH - 1)
        if len(b.alone):
            places = b.windows_of(b.alone)
            keys, inverse = np.unique(_hash_at(b.buf, places, LENGTH), return_inverse=True)
            hit = places[answers(held, _WINDOWS, np.uint8)[inverse] > 0]
            mark(hit, hit + LENGTH)
        gone = np.cumsum(marks)[:-1] > 0
        s, e, doc = B.runs(gone, b.off)
        rows = len(b.off) - 1
        kept = np.concatenate([[0], np.cumsum(~gone)])
        data = b.buf[~gone].tobytes()
        ends = kept[b.off]
        digests = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(ends.tolist(), ends[1:].tolist())]
        sizes = np.diff(b.off)
        out = {"doc_id": b.ids.combine_chunks(), "n_bytes": sizes, "n_removed": sizes - np.diff(ends), "n_spans": np.bincount(doc, minlength=rows).astype(np.int64), "kept_sha256": pa.array(digests, pa.string())}
        if spans:
            cuts = np.searchsorted(doc, np.arange(rows + 1))
            pairs = [{"start": int(x), "stop": int(y)} for x, y in zip(s - b.off[doc], e - b.off[doc])]
            out["removed"] = pa.array([pairs[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield out

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["removed"] * spans]
    schema = f"doc_id {id_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<struct<start:long,stop:long>>" * spans

    def make(rows):
        return pa.RecordBatch.from_arrays([c if isinstance(c := rows[0][x], pa.Array) else pa.array(c) for x in names], names=names)

    return by_part(blocks.union(first).union(second), n, cut, schema, make)
