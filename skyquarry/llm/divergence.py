"""Divergence of the sources of a language, by smoothed term shares in whole numbers.

Terms are runs of letters (A-Z, a-z and all that is not ASCII; A-Z lower-cased). A look-up table over the joined UTF-8 buffer of a slice
finds their bounds; xxhash groups equal ones and every slice is compared byte by byte with the one that stands for its group. Counts and
document frequencies by language, source and term are added up within a task, then by one shuffle on (language, term), which also tells
the terms that enough documents of the language hold. A language's kept terms are divided into blocks by their hash; a block is a sparse
matrix of sources by terms (CSR) and gives its part of each pair's divergence and the best terms of each source; parts are added up.

Share of a term in a group: p = 1 + floor(1e9 * (count + 5) / (N + 5 V)); N: the group's occurrences of kept terms, V: the language's
kept terms. A pair of sources diverges by the sum of |p - q| over all kept terms; a term of a source by |p - q|, q the language's share.

Defined results: null text, lang and source are the empty text; every row is a document, repeated ids and rows included; a group without
kept terms has the shares of N = 0, and without any kept term in the language all pairs are 0; ties go by the item's UTF-8 bytes; a table
without rows gives no rows; other columns are ignored. The whole is exact while N + 5 V stays below 2^63 / 1000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import materialise, releasing, slices

LEAST_DOCS, SMOOTH, SCALE = 30, 5, 1_000_000_000
#: Entries of a task's counts that are held before they are handed on.
HELD = 800_000
#: Bytes of text that are cut into terms at once.
SLICE = 1 << 21
#: Cells (sources times terms) of a block.
CELLS = 1 << 16
_COUNTS = "lang string, source string, term binary, n long, docs long"


# -- terms

def term_groups(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each slice of buf the number of its distinct byte string, and those strings."""
    data = buf.tobytes()
    cut = [data[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(cut))
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    texts = [cut[i] for i in first.tolist()]
    unlike = differing(buf, starts, stops, first[of])
    if len(unlike):  # equal hashes of unequal bytes: these are told apart by their bytes
        known: dict[bytes, int] = {}
        for i in unlike.tolist():
            if cut[i] not in known:
                known[cut[i]] = len(texts)
                texts.append(cut[i])
            of[i] = known[cut[i]]
    return of, texts


def differing(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The slices whose bytes are not those of slice like[i]."""
    sizes = stops - starts
    wrong = sizes != sizes[like]
    same = np.flatnonzero(~wrong & (like != np.arange(len(like))))
    n = sizes[same]
    if n.sum():
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        equal = buf[np.repeat(starts[same], n) + step] == buf[np.repeat(starts[like[same]], n) + step]
        wrong[same[~np.logical_and.reduceat(equal, ends - n)]] = True
    return np.flatnonzero(wrong)


def slice_counts(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """For each group of texts (group: a number for each text) its terms, and for each of these documents + occurrences * 2^32."""
    buf, off = B.flat(texts)
    low = B.LOWER[buf]
    starts, stops, doc = B.runs(B.LETTER[buf], off)
    if not len(starts):
        return
    of, terms = term_groups(low, starts, stops)
    width = len(terms)
    pair, n = np.unique(doc * width + of, return_counts=True)  # by document and term
    key = group[pair // width] * width + pair % width
    order = np.argsort(key, kind="stable")
    key, counts = key[order], (n[order] << 32) + 1
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sums, key = np.add.reduceat(counts, first), key[first]
    ends = np.flatnonzero(np.append(key[1:] // width != key[:-1] // width, True)) + 1
    for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        yield int(key[a]) // width, [terms[k] for k in (key[a:b] % width).tolist()], sums[a:b].tolist()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: added up within tasks, so that a key has few rows for each task."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            both = np.fromiter(terms.values(), np.int64, len(terms))
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(both)), pa.repeat(pa.scalar(source, pa.string()), len(both)), pa.array(list(terms), pa.binary()), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for part in slices(batches, limit=SLICE):
            names = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist()))
            number = {name: i for i, name in enumerate(dict.fromkeys(names))}
            into = [held.setdefault(name, {}) for name in number]
            for g, terms, counts in slice_counts(part.column("text"), np.array([number[name] for name in names], np.int64)):
                mine = into[g]
                size -= len(mine)
                had = mine.get
                for term, both in zip(terms, counts):
                    mine[term] = had(term, 0) + both  # a task has fewer than 2^32 documents and 2^31 occurrences of a term
                size += len(mine)
            if size > HELD:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    return documents.select("lang", "source", "text").mapInArrow(releasing(run), _COUNTS)


# -- shares and divergences

def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / total) by long division, three digits at a time."""
    rest, out = count + SMOOTH, np.zeros(np.broadcast(count, total).shape, np.int64)
    whole, rest = np.divmod(rest, total)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + out


def row_sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of a CSR matrix's rows; reduceat alone would give an empty row its neighbour's value."""
    out = np.zeros(len(indptr) - 1, np.int64)
    full = np.flatnonzero(np.diff(indptr))
    if len(full):
        out[full] = np.add.reduceat(values, indptr[full])
    return out


def pair_parts(p: np.ndarray, p0: np.ndarray, indices: np.ndarray, indptr: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Row by row, the sums over the block's columns of |p of the row - p of each row|. p: shares of the CSR entries, p0: of absent ones."""
    per = np.diff(indptr)
    absent = np.repeat(p0, per)
    for s in range(len(p0)):
        mine = np.full(width, p0[s])
        own = slice(indptr[s], indptr[s + 1])
        mine[indices[own]] = p[own]
        at_theirs = mine[indices]
        out = row_sums(np.abs(p - at_theirs) - np.abs(absent - at_theirs), indptr)  # their entries, over what absence would give
        # as if they had none: their p0 against all of mine
        level, times = np.unique(mine, return_counts=True)
        order = np.searchsorted(level, p0)
        low_n, low_sum = np.append(0, np.cumsum(times)), np.append(0, np.cumsum(level * times))
        below = p0 * low_n[order] - low_sum[order]
        above = (low_sum[-1] - low_sum[order]) - p0 * (low_n[-1] - low_n[order])
        yield out + below + above


def _block(best: int):
    """A function of one block's rows: its part of the pairs, and the `best` terms of each source."""

    def work(rows: pa.Table) -> pa.Table:
        term = rows.column("term").to_pylist()
        is_group = np.array([t is None for t in term], bool)
        source, n = np.array(rows.column("source").to_pylist(), object), rows.column("n").to_numpy()
        lang, kept, all_n = rows.column("lang")[0].as_py(), rows.column("kept")[0].as_py(), rows.column("lang_n")[0].as_py()
        order = sorted(np.flatnonzero(is_group).tolist(), key=lambda i: source[i].encode())
        names = [source[i] for i in order]
        number = {name: i for i, name in enumerate(names)}
        total = n[order] + SMOOTH * kept
        out = {"source": [], "part": [], "item": [], "value": []}

        def add(s, part, item, value):
            out["source"].append(names[s])
            out["part"].append(part)
            out["item"].append(item)
            out["value"].append(int(value))

        if not kept:
            for s in range(len(names)):
                for t in range(len(names)):
                    if s != t:
                        add(s, "pair", names[t], 0)
        else:
            cells = np.flatnonzero(~is_group)
            terms = sorted({term[i] for i in cells.tolist()})
            column = {t: i for i, t in enumerate(terms)}
            r = np.array([number[source[i]] for i in cells.tolist()], np.int64)
            c = np.array([column[term[i]] for i in cells.tolist()], np.int64)
            at = np.lexsort((c, r))
            r, c, count = r[at], c[at], n[cells[at]]
            indptr = np.searchsorted(r, np.arange(len(names) + 1))
            p, p0 = shares(count, total[r]), shares(np.zeros(len(names), np.int64), total)
            for s, values in enumerate(pair_parts(p, p0, c, indptr, len(terms))):
                for t, value in enumerate(values.tolist()):
                    if s != t:
                        add(s, "pair", names[t], value)
            whole = np.zeros(len(terms), np.int64)
            np.add.at(whole, c, count)
            q = shares(whole, np.array(all_n + SMOOTH * kept, np.int64))
            over = p - q[c]
            for s in range(len(names)):
                own = np.arange(indptr[s], indptr[s + 1])
                own = own[over[own] > 0]
                for i in own[np.lexsort((c[own], -over[own]))][:best].tolist():  # columns are in the order of the terms' bytes
                    add(s, "term", terms[c[i]].decode(), over[i])
        kinds = {"source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
        return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string())} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return work


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, best: int = 50, cells: int = CELLS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see the module's text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("lang"), blank("source"), blank("text"))
    dealt = term_counts(docs).repartition("lang", "term")  # the one shuffle of counts: the next two steps need no other
    added = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one_term = Window.partitionBy("lang", "term")
    known = added.withColumn("_docs", F.sum("docs").over(one_term)).where(F.col("_docs") >= least_docs)
    known = known.withColumn("first", F.row_number().over(one_term.orderBy("source")) == 1)
    kept = materialise(known.select("lang", "source", "term", "n", "first"), "terms")
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("_first"))
    group = materialise(docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left").fillna(0), "groups")
    langs = group.groupBy("lang").agg(F.sum("_first").alias("kept"), F.sum("n").alias("lang_n"), F.count("*").alias("_sources"))
    langs = materialise(langs.select("lang", "kept", "lang_n", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("_sources") / cells)).cast("long").alias("_blocks")), "langs")
    # files of known size: Spark broadcasts `langs` only below its own threshold
    columns = ["lang", "block", "source", "term", "n", "kept", "lang_n"]
    entries = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "_blocks")).select(columns)
    heads = group.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("term", F.lit(None).cast("binary")).select(columns)
    parts = entries.unionByName(heads).groupBy("lang", "block").applyInArrow(_block(best), "lang string, source string, part string, item string, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block
    return summed.withColumn("rank", _rank()).where((F.col("part") == "pair") | (F.col("rank") <= best))


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
