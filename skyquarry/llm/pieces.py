"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary is read from a sentencepiece model file, whose path is a parameter; nothing is trained. Supported are BPE
models with the identity normaliser, a dummy prefix, kept white space and pieces that have the space mark at their start only;
other models are refused. Then words (a run of space marks with what follows) can't influence each other.

Encoding: the distinct words of a slice are sorted by length and laid side by side in grids, a column for each word. Each round takes
the minimum of (rank, position) over every column, merges that leftmost best pair in every word at once, and looks up the two pairs
that this makes in an open hash table; the places of a column are linked, so nothing moves. This is the order in which the library
merges. Words of more than `LONG` symbols take an agenda (a heap) instead, which is exact too and not quadratic. Symbols outside the
vocabulary become bytes. Words, ids and texts stay in Arrow arrays: a text's ids, and what they decode to, are taken by word.

Defined results: a null text is an empty text, whose only id is the end id; each input row gives one row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bytesops as B
from .shared import map_slices

MARK = "▁"
LONG = 64
CACHE_WORDS = 60_000
#: Words of a grid, and bytes of text whose distinct words are encoded together.
GRID_WORDS, DIGEST_BYTES = 8192, 4 << 20
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NONE = np.int64(1) << 20  # above any rank
_GONE = np.int32(-(1 << 31))  # a place without symbol; characters without symbol are -1 - their code point
_EMPTY, _SPREAD = np.int64(-2), np.uint64(0x9E3779B97F4A7C15)


def _split(text: str) -> list[str]:
    """The words of a text: the dummy prefix and spaces become marks, and each run of marks begins a word."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def _words(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts as `_split` cuts them, with spaces for marks, and each text's first word (with the end); null is empty."""
    mark, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    plain = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
    buf, off = B.flat(pc.if_else(pc.equal(pc.binary_length(plain), 0), plain, pc.binary_join_element_wise(mark, plain, nothing)))
    gap = buf == ord(" ")
    begins = gap.copy()
    begins[1:] &= ~gap[:-1]
    begins[off[off < len(buf)]] = True
    starts = np.flatnonzero(begins)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)), np.searchsorted(starts, off)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ... sizes[0] numbers on, then starts[1], ..."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _parts(a: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a fresh large string or binary array."""
    return np.frombuffer(a.buffers()[1], np.int64, len(a) + 1) if len(a) else np.zeros(1, np.int64), memoryview(a.buffers()[2] or b"")


def _lists(a: pa.LargeListArray) -> list[list[int]]:
    values, offsets = a.values.to_numpy().tolist(), a.offsets.to_numpy().tolist()
    return [values[i:j] for i, j in zip(offsets, offsets[1:])]


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields; varints and fixed as int, the rest as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces of a model: strings, scores, kinds (1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte)."""

    strings: list[str]
    scores: np.ndarray
    kinds: list[int]
    bpe: bool
    plain: bool

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            data = f.read()
        strings, scores, kinds, bpe, plain = [], [], [], False, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                strings.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0])
                kinds.append(piece.get(3, 1))
            elif number == 2:
                spec = dict(_fields(value))
                bpe = spec.get(3, 1) == 2
                plain &= not spec.get(24, 0)
            elif number == 3:
                spec = dict(_fields(value))
                plain &= spec.get(1, b"") == b"identity" and not spec.get(2, b"") and spec.get(3, 1) == 1 and spec.get(4, 1) == 0
        return cls(strings, np.array(scores), kinds, bpe, plain)


def _slot(key: np.ndarray, n: int) -> np.ndarray:
    return (key.view(np.uint64) * _SPREAD >> np.uint64(65 - n.bit_length())).astype(np.int64)


def _table_of(keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table with linear probing: keys, and beside them rank << 32 | merged symbol."""
    n = 1 << (4 * len(keys)).bit_length()
    slots, gains, slot, todo = np.full(n, _EMPTY), np.zeros(n, np.int64), _slot(keys, n), np.arange(len(keys))
    while len(todo):
        free = todo[slots[slot[todo]] == _EMPTY]
        _, first = np.unique(slot[free], return_index=True)
        placed = free[first]
        slots[slot[placed]], gains[slot[placed]] = keys[placed], ranks[placed] << 32 | merged[placed]
        todo = np.setdiff1d(todo, placed, assume_unique=True)
        slot[todo] = (slot[todo] + 1) & (n - 1)
    return slots, gains


@dataclass
class Merger:
    """The merge table of a BPE vocabulary, and its encoder and decoder."""

    strings: list[str]
    symbols: dict[str, int]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: list[int]
    byte_of: dict[int, int]
    end: int
    hidden: set[int]
    names: dict[int, str]
    of_char: np.ndarray
    slots: np.ndarray
    gains: np.ndarray
    numbers: pa.LargeBinaryArray
    surfaces: pa.LargeBinaryArray
    _cache: dict = field(default_factory=dict)

    @classmethod
    def of(cls, v: Vocabulary) -> Merger:
        mid = re.compile(f"[^{MARK}]{MARK}")
        if not v.bpe or not v.plain or 4 in v.kinds or 5 in v.kinds or any(k == 1 and mid.search(s) for s, k in zip(v.strings, v.kinds)):
            raise ValueError("only BPE models with the identity normaliser, a dummy prefix and space marks at the start of pieces are supported")
        ids = {s: i for i, (s, k) in enumerate(zip(v.strings, v.kinds)) if k == 1}
        chars = sorted({c for s in ids for c in s} - ids.keys())
        symbols = ids | {c: len(v.strings) + i for i, c in enumerate(chars)}  # single characters that are no piece can still be a part of one
        order = {x: r for r, x in enumerate(sorted({float(v.scores[i]) for i in ids.values()}, reverse=True))}
        width = len(symbols) + len(v.strings)
        rows = [(symbols[s[:k]] * width + symbols[s[k:]], order[float(v.scores[i])], i) for s, i in ids.items() for k in range(1, len(s)) if s[:k] in symbols and s[k:] in symbols]
        keys, ranks, merged = np.array(sorted(rows), np.int64).T
        byte_ids = [0] * 256
        for i, (s, k) in enumerate(zip(v.strings, v.kinds)):
            if k == 6:
                byte_ids[int(s[3:5], 16)] = i
        hidden = {i for i, k in enumerate(v.kinds) if k == 3}
        of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                of_char[ord(c)] = i
        byte_of = {i: b for b, i in enumerate(byte_ids) if i}
        shown = [bytes([byte_of[i]]) if i in byte_of else b"" if i in hidden else (s.replace(MARK, " ") if i else " ⁇ ").encode() for i, s in enumerate(v.strings)]
        return cls(
            v.strings, symbols, keys, ranks, merged, byte_ids, byte_of, v.strings.index("</s>"), hidden, {i: s for s, i in symbols.items() if i >= len(v.strings)}, of_char,
            *_table_of(keys, ranks, merged), pa.array([b"%d " % i for i in range(len(v.strings))], pa.large_binary()), pa.array(shown, pa.large_binary()),
        )

    @property
    def width(self) -> int:
        return len(self.symbols) + len(self.strings)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (or none) and merged symbols of pairs of symbols; below 0 is no symbol of the table."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        slot = _slot(key, len(self.slots))
        found = self.slots[slot]
        todo = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            found[todo] = self.slots[slot[todo]]
            todo = todo[(found[todo] != key[todo]) & (found[todo] != _EMPTY)]
        gain = self.gains[slot]
        return np.where(found == key, gain >> 32, _NONE).astype(np.int32), gain.astype(np.int32)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        return _lists(self._encoded(pa.array(words, pa.large_string())))

    def _encoded(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """The ids of each word, in which spaces are marks."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.frombuffer(B.flat(words)[0].tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        code[code == ord(" ")] = ord(MARK)
        sym = self.of_char[code]
        sym[sym < 0] = -1 - code[sym < 0].astype(np.int32)
        begin = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        short = order[: np.searchsorted(size[order], LONG, "right")]
        done = [self._grid(sym, begin[w], size[w]) for w in (short[i : i + GRID_WORDS] for i in range(0, len(short), GRID_WORDS))]
        long = [self._agenda("".join(map(chr, code[begin[w] : begin[w] + size[w]].tolist()))) for w in order[len(short) :].tolist()]
        ids = np.concatenate([*(d[0] for d in done), *(np.array(x, np.int32) for x in long), np.zeros(0, np.int32)])
        ends = np.cumsum(np.concatenate([*(d[1] for d in done), np.array([len(x) for x in long], np.int64)]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int64)), pa.array(ids)).take(pa.array(back))

    def _grid(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most `LONG` symbols, one after another, and how many each has."""
        rows, n = int(size.max()), len(size)
        place = np.arange(rows + 1, dtype=np.int32)[:, None]  # a last row stands for what is beyond a word
        sym = np.where(place < size, symbols[np.minimum(begin + place, len(symbols) - 1)], _GONE)
        after, before = np.where(place < size - 1, place + 1, rows).astype(np.int32), np.where((place > 0) & (place < size), place - 1, rows).astype(np.int32)
        rank, gain = self._pairs(sym[:-1].ravel(), sym[1:].ravel())
        best_of, none = rank.reshape(rows, n) * LONG + place[:-1], int(_NONE) * LONG  # LONG places fit beside a rank
        best_of, gain = np.concatenate([best_of, np.full((1, n), none, np.int32)]).ravel(), np.append(gain, np.zeros(n, np.int32))
        sym, after, before = sym.ravel(), after.ravel(), before.ravel()
        while True:
            best = best_of[: rows * n].reshape(rows, n).min(axis=0)
            word = np.flatnonzero(best < none)
            if not len(word):
                break
            at = best[word].astype(np.int64) % LONG
            here = at * n + word
            gone = after[here].astype(np.int64) * n + word
            new, then = gain[here], after[gone]
            sym[here], after[here], sym[gone], best_of[gone] = new, then, _GONE, none
            right = then.astype(np.int64) * n + word
            before[right] = at
            first = before[here].astype(np.int64)
            left = first * n + word
            both = np.concatenate([here, left])
            rank, gain[both] = self._pairs(np.concatenate([new, sym[left]]), np.concatenate([sym[right], new]))
            best_of[both] = rank * LONG + np.concatenate([at, first]).astype(np.int32)
        held = sym.reshape(rows + 1, n)[:rows].T
        alive = held != _GONE
        out, count = held[alive], alive.sum(axis=1)
        odd = np.flatnonzero((out < 0) | (out >= len(self.strings)))
        if not len(odd):
            return out, count
        kinds, kind = np.unique(out[odd], return_inverse=True)
        as_bytes = [self._ids([x]) for x in kinds.tolist()]
        length = np.array([len(x) for x in as_bytes])
        repeats = np.ones(len(out), np.int64)
        repeats[odd] = length[kind]
        ends = np.append(0, np.cumsum(repeats))
        whole = np.repeat(out, repeats)
        whole[_ragged(ends[odd], length[kind])] = np.concatenate(as_bytes)[_ragged((np.cumsum(length) - length)[kind], length[kind])]
        return whole, np.diff(ends[np.append(0, np.cumsum(count))])

    def _ids(self, symbols: list[int]) -> list[int]:
        top = len(self.strings)
        ids = []
        for x in symbols:
            ids += [x] if 0 <= x < top else [self.byte_ids[b] for b in (self.names[x] if x >= 0 else chr(-1 - x)).encode()]
        return ids

    def _agenda(self, word: str) -> list[int]:
        """One word by a heap of pairs over a linked list: for words too long for rounds."""
        get = self.symbols.get
        sym = [get(c, -1 - ord(c)) for c in word]
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        heap: list[tuple[int, int, int, int, int]] = []
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (hit := self._table.get(sym[i] * self.width + sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        gone = [False] * len(sym)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = new, True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self._ids([x for x, g in zip(sym, gone) if not g])

    def _lookup(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """The ids of distinct words; those of the slice before are kept."""
        known, ids = self._cache.get("last", (words[:0], pa.array([], pa.large_list(pa.int32()))))
        at = pc.index_in(words, value_set=known)
        fresh = pc.is_null(at)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        new = fresh.to_numpy(zero_copy_only=False)
        place[new] = len(known) + np.arange(new.sum())
        found = pa.concat_arrays([ids, self._encoded(words.filter(fresh)).cast(ids.type)]).take(pa.array(place))
        self._cache["last"] = words, found
        return found

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, pa.LargeListArray, pa.Array]:
        """Each text's first word (with the end), the ids of the distinct words, and each word's number among those."""
        words, cut = _words(texts)
        coded = words.dictionary_encode()
        return cut, self._lookup(coded.dictionary), coded.indices

    def encode_texts(self, texts: list[str]) -> list[list[list[int]]]:
        """For each text the ids of its words, in order, without end id."""
        cut, ids, index = self._coded(pa.array(texts, pa.large_string()))
        of_word = _lists(ids.take(index))
        return [of_word[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def _joined(self, table: pa.LargeBinaryArray, ids: pa.LargeListArray) -> pa.LargeBinaryArray:
        """For each word the entries of its ids, one after another."""
        offsets, data = _parts(table.take(ids.values))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets[ids.offsets.to_numpy()]), pa.py_buffer(data)])

    def _shown(self, ids: pa.LargeListArray) -> pa.LargeBinaryArray:
        """For each word what its ids decode to; the dummy prefix is the text's affair, so it is kept."""
        try:
            text = self._joined(self.surfaces, ids).cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            text = pa.array([self.decode([self.byte_ids[0], *x])[1:] for x in ids.to_pylist()], pa.large_string())
        return pc.replace_substring(text, MARK, " ").cast(pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are gathered into UTF-8, invalid bytes become U+FFFD, control ids are silent, the dummy prefix goes."""
        parts: list[str] = []
        pending = bytearray()
        first = True
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                parts.append(_utf8(bytes(pending)))
                pending.clear()
                first = False
            if i in self.hidden:
                continue
            s = self.strings[i] if i else " ⁇ "
            if first and s.startswith(MARK):
                s = s[1:]
            first = False
            parts.append(s)
        if pending:
            parts.append(_utf8(bytes(pending)))
        return "".join(parts).replace(MARK, " ")


def _utf8(data: bytes) -> str:
    """Valid sequences decoded, each other byte as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>, with the end id)."""
    shared = documents.sparkSession.sparkContext.broadcast(Merger.of(Vocabulary.read(path)))  # the vocabulary, whatever the input

    def work(part):
        m = shared.value
        cut, ids, index = m._coded(part.column("text"))
        of_word = ids.take(index)
        ends = of_word.offsets.to_numpy()[cut]
        ids = np.insert(of_word.values.to_numpy(), ends[1:], m.end)
        yield {"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(ids))}

    kind = dict(documents.dtypes)["doc_id"]
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, ids array<int>", work, finish=lambda: shared.value._cache.clear())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Merger.of(Vocabulary.read(path)))
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shared.value.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(documents: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Both digests are made of the ids: words repeat, so the decimal form and the decoded form of a word's ids are made once in a slice."""
    shared = documents.sparkSession.sparkContext.broadcast(Merger.of(Vocabulary.read(path)))

    def work(part):
        m = shared.value
        cut, ids, index = m._coded(part.column("text"))
        n_ids = np.append(0, np.cumsum(np.diff(ids.offsets.to_numpy())[index.to_numpy()]))
        (at, numbers), (shown_at, shown) = (_parts(x.take(index)) for x in (m._joined(m.numbers, ids), m._shown(ids)))
        end, ids_hash, text_hash = str(m.end).encode(), [], []
        for a, b, c, d in zip(*(x.tolist() for x in (at[cut[:-1]], at[cut[1:]], shown_at[cut[:-1]], shown_at[cut[1:]]))):
            h = hashlib.sha256(numbers[a:b])
            h.update(end)
            ids_hash.append(h.hexdigest())
            text_hash.append(hashlib.sha256(shown[c:d][1:]).hexdigest())  # without the dummy prefix
        yield {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(n_ids[cut]) + 1, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}

    kind = dict(documents.dtypes)["doc_id"]
    return map_slices(documents.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work, finish=lambda: shared.value._cache.clear(), limit=DIGEST_BYTES)
