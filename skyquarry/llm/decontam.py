"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters (A-Z lower-cased), digits and non-ASCII bytes. A mask fixes some of `SPAN` consecutive token positions and
ignores the others, so a substituted token there leaves the hash as it is. The masked hashes of all benchmark positions are joined
with those of every document position, salted; both rows carry the tokens around, so a hit is verified where it is found: the document and the item
lie side by side and the equal tokens are counted. An item is found where some window of `WINDOW` aligned tokens has at
most `ERRORS` unequal ones. Shorter items, down to one token, are one window with a tolerance in proportion, floor(ERRORS * tokens / WINDOW):
one error from 7 tokens on, none below. The two masks hit every placement of two errors in a long window. A short window with an error
has one half without: its halves are seeds (two plain runs), without tolerance the whole of it is one.

Before the join a bitmap of the benchmark's hashes, of at most `FILTER_BITS`, is sent to all tasks, and positions that can't meet
anything stay at home. A larger benchmark makes it less selective, never wrong.

Defined results: null or empty texts and items, and those without tokens, match nothing; repeated items count once
(the smallest item_id); each document row gives one row; other columns are ignored; an empty benchmark leaves all clean. Ids may have any orderable type.
Document rows with the same id are told apart by 64 bits of their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import bytesops as B
from .shared import fresh, materialise, slices

SPAN = 8
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 6, 7))
WINDOW, ERRORS = 13, 2
#: Tokens that a seed carries: from BACK before it, SIDE in all; enough for every window around it.
BACK, SIDE = 6, 19
SALTS = 8
FILTER_BITS = 28
_TOKEN = B.LETTER.copy()
_TOKEN[ord("0") : ord("9") + 1] = True


def tolerance(n: int) -> int:
    """The unequal tokens allowed in an item's window, for an item of n tokens."""
    return ERRORS * min(n, WINDOW) // WINDOW


def shapes(n: int) -> list[tuple[tuple[int, ...], int | None]]:
    """The seeds of an item of n tokens: masks, and the one place where each begins (None: all places)."""
    if n >= WINDOW:
        return [(m, None) for m in MASKS]
    if not tolerance(n):
        return [(tuple(range(n)), 0)]
    half = n // 2
    return [(tuple(range(half)), 0), (tuple(range(n - half)), half)]


#: All masks that items can have; their numbers salt the hashes.
EVERY_MASK = tuple(dict.fromkeys(m for n in range(WINDOW, 0, -1) for m, _ in shapes(n)))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a slice, their texts' numbers, and each text's first token."""
    buf, off = B.flat(texts)
    starts, stops, doc = B.runs(_TOKEN[buf] if len(buf) else np.zeros(0, bool), off)
    h, _ = B.word_hashes(B.LOWER[buf], starts, stops)
    return h, doc, np.searchsorted(doc, np.arange(len(off)))


def _masked(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The masked hashes of all places where the mask fits."""
    n = max(len(h) - mask[-1], 0)
    out = np.full(n, np.uint64(EVERY_MASK.index(mask) + 1))
    for j in mask:
        out = B.mix(out * B.FNV_PRIME + h[j : j + n])
    return out


def _sides(h: np.ndarray, of: np.ndarray, at: np.ndarray, absent: int) -> pa.Array:
    """The tokens around each place, `absent` beyond its text."""
    where = at[:, None] + np.arange(-BACK, SIDE - BACK)
    inside = (where >= 0) & (where < len(h))
    where = np.clip(where, 0, max(len(h) - 1, 0))
    values = np.where(inside & (of[where] == of[at][:, None]), h[where] | np.uint64(3), np.uint64(absent))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * SIDE, pa.int32()), pa.array(values.ravel().view(np.int64)))


def _mapped(df: DataFrame, work, names: list[str], extra: list[tuple[str, object]]) -> DataFrame:
    """mapInArrow over slices of df's texts that yields the columns `names` of df for chosen rows, and `extra` ones."""
    schema = StructType([df.schema[n] for n in names] + [StructField(n, t) for n, t in extra])

    def run(batches):
        for part in slices(batches):
            for of, columns in work(part):
                chosen = part.select(names).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*chosen.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def seeds(benchmark: DataFrame) -> DataFrame:
    """item, item_id, key, size, at, around: the masked hashes of the distinct items, with their tokens around."""
    items = benchmark.where("length(text) > 0").groupBy("text").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("text").alias("item"), "item_id", "text")

    def work(part):
        h, of, first = tokens(part.column("text"))
        size = np.diff(first)
        for mask in EVERY_MASK:
            key = _masked(h, mask)
            at = np.arange(len(key))
            at = at[of[at] == of[at + mask[-1]]] if len(at) else at
            place, n = at - first[of[at]], size[of[at]]
            keep = np.zeros(len(at), bool)
            for length in np.unique(n).tolist():
                for m, only in shapes(length):
                    if m == mask:
                        keep |= (n == length) & (True if only is None else place == only)
            at = at[keep]
            if len(at):
                yield of[at], [pa.array(key[at].view(np.int64)), pa.array(size[of[at]].astype(np.int32)), pa.array((at - first[of[at]]).astype(np.int32)), _sides(h, of, at, 1)]

    return _mapped(items, work, ["item", "item_id"], [("key", LongType()), ("size", IntegerType()), ("at", IntegerType()), ("around", ArrayType(LongType()))])


def _filter(found: DataFrame, most_bits: int) -> tuple[np.ndarray, int, tuple[tuple[int, ...], ...]]:
    """A bitmap of the keys by their leading bits (their number too), and the masks that occur."""
    keys = found.select("key").distinct()
    n = keys.count()
    bits = min(max(16, (16 * n).bit_length()), most_bits)
    at = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("at"))
    words = at.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sizes = [r.size for r in found.select(F.least("size", F.lit(WINDOW)).alias("size")).distinct().collect()]  # at most WINDOW numbers
    used = {m for s in sizes for m, _ in shapes(s)}
    return bitmap, bits, tuple(m for m in EVERY_MASK if m in used)


def _candidates(documents: DataFrame, bitmap: np.ndarray, bits: int, masks: tuple) -> DataFrame:
    """doc_id, print, key, place, beside: the documents' positions that the bitmap admits."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)  # at most 2 ** FILTER_BITS bits

    def work(part):
        h, of, first = tokens(part.column("text"))
        for mask in masks:
            key = _masked(h, mask)
            at = (key >> np.uint64(64 - bits)).astype(np.int64)
            hit = np.flatnonzero(shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            hit = hit[of[hit] == of[hit + mask[-1]]] if len(hit) else hit
            for i in range(0, len(hit), 1 << 14):
                some = hit[i : i + (1 << 14)]
                yield of[some], [pa.array(key[some].view(np.int64)), pa.array((some - first[of[some]]).astype(np.int32)), _sides(h, of, some, 2)]

    return _mapped(documents, work, ["doc_id", "print"], [("key", LongType()), ("place", IntegerType()), ("beside", ArrayType(LongType()))])


def verified(size: np.ndarray, at: np.ndarray, around: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of tokens side by side (n x SIDE): which are equal within a window that is found, and where the first such window begins (SIDE: none)."""
    same, there = around == beside, (around > 3) | (around < 0)
    there &= (beside > 3) | (beside < 0)
    covered, begin = np.zeros(same.shape, bool), np.full(len(size), SIDE)
    width = np.minimum(size, WINDOW)
    for w in np.unique(width).tolist():
        allowed = tolerance(w)
        for a in range(SIDE - w + 1):
            rows = width == w
            if w < WINDOW:
                rows &= a == BACK - at  # the whole item
            good = rows & there[:, a : a + w].all(1) & (same[:, a : a + w].sum(1) >= w - allowed)
            covered[good, a : a + w] = True
            begin[good] = np.minimum(begin[good], a)
    return same & covered, begin


def _matches(documents: DataFrame, benchmark: DataFrame, most_bits: int) -> DataFrame:
    """doc_id, print, item, item_id, overlap, word: the items found in distinct pairs of doc_id and text (print: its hash)."""
    found = materialise(seeds(benchmark), "seeds")
    bitmap, bits, masks = _filter(found, most_bits)
    rows = documents.select("doc_id", F.xxhash64("text").alias("print"), "text")
    mine = _candidates(rows, bitmap, bits, masks).withColumn("salt", F.pmod(F.xxhash64("doc_id", "print", "place"), F.lit(SALTS)).cast("int"))
    theirs = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = mine.join(theirs, ["key", "salt"]).select("doc_id", "print", "item", "item_id", "size", "at", "place", "around", "beside")
    kept = ["doc_id", "print", "item", "item_id", "size"]
    schema = StructType([met.schema[n] for n in kept] + [StructField("diagonal", IntegerType()), StructField("places", ArrayType(IntegerType())), StructField("word", IntegerType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size, at, place = (batch.column(c).to_numpy() for c in ("size", "at", "place"))
            around, beside = (batch.column(c).flatten().to_numpy().reshape(-1, SIDE) for c in ("around", "beside"))
            equal, begin = verified(size, at, around, beside)
            good = np.flatnonzero(begin < SIDE)
            row, column = np.nonzero(equal[good])
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(good))))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((at[good][row] + column - BACK).astype(np.int32)))
            columns = [place[good] - at[good], places, place[good] - BACK + begin[good]]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).take(pa.array(good)).columns, *(c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for c in columns)], names=schema.names)

    # one diagonal's places are those of one item
    hits = met.mapInArrow(run, schema)
    aligned = hits.withColumn("places", F.explode("places")).groupBy(*kept, "diagonal").agg(F.count_distinct("places").alias("equal"), F.min("word").alias("word"))
    best = aligned.groupBy(*kept).agg(F.max(F.struct("equal", (-F.col("word")).alias("word"))).alias("best"))
    return materialise(best.select("doc_id", "print", "item", "item_id", (F.col("best.equal") / F.col("size")).alias("overlap"), (-F.col("best.word")).cast("long").alias("word")), "contaminated")


def _joined(left: DataFrame, right: DataFrame, how: str, mark: Column) -> DataFrame:
    return left.join(right, left["doc_id"].eqNullSafe(right["_doc"]) & (mark == right["_print"]), how)


def clean(documents: DataFrame, benchmark: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    found = _matches(documents.select("doc_id", "text"), benchmark, most_bits).select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print")).distinct()
    (mark,) = fresh(documents, "_mark")
    marked = documents.withColumn(mark, F.xxhash64("text"))
    return _joined(marked, found, "left_anti", marked[mark]).select(*(F.col(f"`{c}`") for c in documents.columns))


def _summed(documents: DataFrame, benchmark: DataFrame, most_bits: int, *aggregates: Column) -> DataFrame:
    """doc_id of each document row, beside aggregates of its matches."""
    found = _matches(documents.select("doc_id", "text"), benchmark, most_bits)
    grouped = found.groupBy(F.col("doc_id").alias("_doc"), F.col("print").alias("_print")).agg(*aggregates)
    rows = documents.select("doc_id", F.xxhash64("text").alias("_mark"))
    return _joined(rows, grouped, "left", rows["_mark"]).drop("_doc", "_print", "_mark")


def _first() -> Column:
    """The order of a document's items: the largest overlap, then the smallest id."""
    return F.struct(-F.col("overlap"), F.col("item_id").isNull(), "item_id", "item", "word", "overlap")


def overlaps(documents: DataFrame, benchmark: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, hits: for each document row the items found, as array<struct<item_id, overlap, word>> with the largest overlap first."""
    listed = _summed(documents, benchmark, most_bits, F.sort_array(F.collect_list(_first())).alias("hits"))
    shown = F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["overlap"].alias("overlap"), h["word"].alias("word")))
    return listed.select("doc_id", F.coalesce(shown, F.array()).alias("hits"))


def flags(documents: DataFrame, benchmark: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (that with the largest overlap), overlap (0 where none), word (its first word in the document)."""
    top = _summed(documents, benchmark, most_bits, F.count("*").alias("n_items"), F.min(_first()).alias("top"))
    return top.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("top.item_id").alias("item_id"), F.coalesce("top.overlap", F.lit(0.0)).alias("overlap"), F.col("top.word").alias("word"))
