"""Exact n-gram Jaccard join of documents by universe partition and pigeonhole.

A document's set holds the hashes of its runs of k words (A-Z lower-cased; words are divided by white space; with fewer words the
whole sequence is one). Documents with equal sets form a class. Two classes link when |A n B| * den >= |A u B| * num.

Candidates. Sizes are cut into bands. A pair belongs to the band of its smaller set; there, linked sets differ in at most H
elements. The universe of hashes is cut into m equal ranges, the segments, and each segment of a set gets a key of its contents. A
band's allocation is chosen by cost (keys, and a penalty for segments too short to be selective):

- exact segments: m = H + 1 + e, so that linked sets agree in at least 1 + e segments. Each set leaves out its e weakest segments
  (fewest elements first, empty ones before all, then by contents). The order looks at contents alone, so the strongest of the
  segments that a pair agrees in is left out by neither: were it among a set's e weakest, so would be the other agreeing ones;
  Shingles that many unlike documents share (fixed lines, licences) would make segments costly: they are one segment of their own, which
  is always left out first. Which shingles these are comes from a bounded sample; the choice changes costs, never results;
- one-deletion neighbourhoods: m = ceil((H + 1) / 2); in some segment linked sets differ in at most one element, so each segment
  gives a key of its contents and one for each of its elements left out.

A set indexes its own band and those lower ones that hold possible smaller partners. Tasks reduce the sets that share a key to a star
around the smallest class before and after the keys are dealt out, so a common key is one entry for each batch of documents. The stars
make candidate components (distributed, see components.py).

Verification. The texts of a candidate component meet in one task if it is small. A larger one is either cut into blocks, whose pairs are
verified in separate tasks, or divided into the groups of classes that share a key, whichever moves fewer bytes: unlike texts that
weak keys chain together then meet only along those keys. Inside a group, pairs that are known to be connected are skipped, which changes
no component; everything else is compared exactly. No candidate is capped.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component; rows with a
repeated doc_id keep a row each; null ids are left out of the smallest id, and a text that only rows without id have links with equal
texts alone; other columns are ignored. Classes are told apart by 64
bits of hash over their elements and size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .blocks import ROWS, ask, by_part, number_of_blocks, squeeze, unpack_sorted, unsqueeze
from .components import components
from .shared import discard, fit_on_texts, fresh, map_slices, materialise, releasing, slices

GROWTH = 1.35
SPARE = 0.3
SELECTIVE = 2
BLOCK_SETS, BLOCK_BYTES = 256, 4 << 20
SALTS, KEY_SALTS = 64, 8
SAMPLE_DOCS, SAMPLE_BYTES, COMMON_LEAST, COMMON_MOST = 6000, 20_000, 4, 200_000
_KEYS, _LINKS = 1, 2


@dataclass(frozen=True)
class Band:
    """Sizes low..high; errors: the most elements in which a linked pair differs whose smaller set is in the band."""

    low: int
    high: int
    errors: int
    segments: int
    spare: int
    deletions: bool


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 34) -> tuple[Band, ...]:
    """The bands and their allocations for the threshold num / den."""
    out, low = [], 1
    while low <= most:
        high = int(low * GROWTH)
        errors = high * (den - num) // num
        spare = int(SPARE * (errors + 1)) + 1
        exact, halves = errors + 1 + spare, (errors + 2) // 2
        # cost of a set of the band's smallest size: its keys, each counted eightfold if segments are likely too short to be selective
        cost_exact = (errors + 1) * (8 if low < SELECTIVE * exact else 1)
        cost_deletions = (halves + low) * (8 if low < SELECTIVE * halves else 1)
        deletions = cost_deletions < cost_exact
        out.append(Band(low, high, errors, halves if deletions else exact, 0 if deletions else spare, deletions))
        low = high + 1
    return tuple(out)


def word_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's set, sorted."""
    buf, off = B.flat(texts)
    ws, we, doc = B.runs(~B.SPACE[buf] if len(buf) else np.zeros(0, bool), off)
    h, _ = B.word_hashes(B.LOWER[buf], ws, we)
    n = len(off) - 1
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.cumsum(counts) - counts
    full, of = B.shingles(h, doc, k)
    cut = np.searchsorted(of, np.arange(n + 1))
    out = []
    for i in range(n):
        if counts[i] >= k:
            out.append(np.unique(full[cut[i] : cut[i + 1]]))
        elif counts[i]:
            whole = np.zeros(1, np.uint64)
            for w in h[first[i] : first[i] + counts[i]]:
                whole = B.mix(whole * B.FNV_PRIME + w)
            out.append(B.mix(whole + np.uint64(int(counts[i]))))  # apart from runs of k words
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """64 bits over the elements and the size of a set, as a signed long."""
    h = B.mix(B.mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s) * 0x9E3779B1))
    return int(h.view(np.int64)[0])


_NO_COMMON = np.zeros(0, np.uint64)


def common_of(texts: list[str], k: int, least: int = COMMON_LEAST, most: int = COMMON_MOST) -> np.ndarray:
    """The shingles of at least `least` unlike texts, sorted; at most `most`, the commonest. Texts with the same smallest hash count once."""
    parts, marks = [], []
    for i in range(0, len(texts), 256):
        for s in word_sets(pa.array(texts[i : i + 256], pa.string()), k):
            if len(s):
                parts.append(s)
                marks.append(np.full(len(s), s[0]))
    if not parts:
        return _NO_COMMON
    s, mark = np.concatenate(parts), np.concatenate(marks)
    order = np.lexsort((mark, s))
    s, mark = s[order], mark[order]
    first = np.append(True, s[1:] != s[:-1])
    unlike = first | np.append(True, mark[1:] != mark[:-1])
    counts = np.add.reduceat(unlike.astype(np.int64), np.flatnonzero(first))
    found = s[first]
    keep = np.lexsort((found, -counts))[:most]
    return np.sort(found[keep[counts[keep] >= least]])


def keys(s: np.ndarray, num: int, den: int, common: np.ndarray = _NO_COMMON) -> np.ndarray:
    """The keys of a set, in all bands where it can meet a partner."""
    return key_lists([s], num, den, common).values.to_numpy()


def key_lists(sets: list[np.ndarray], num: int, den: int, common: np.ndarray = _NO_COMMON) -> pa.ListArray:
    """The distinct keys of each set; the sets of a slice are cut into segments together."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate([*sets, _NO_COMMON]), np.repeat(np.arange(len(sets)), n)
    rare = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat if len(common) else np.ones(len(flat), bool)
    parts = B.mix(flat * B.FNV_PRIME + np.uint64(0x1D8E4E27C47D124F))
    least, most = -(-n * num // den), int(n.max(initial=0))
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for number, band in enumerate(bands(num, den)):
        if band.low > most:
            break
        asked = (band.low <= n) & (band.high >= least)
        if not band.errors or not asked.any():
            continue  # without errors linked sets are equal, that is one class
        # the common shingles are one of the exact segments, and the first of those left out
        segments, spare = (band.segments, 0) if band.deletions else (band.segments - 1, band.spare - 1)
        inside = np.flatnonzero(asked[owner] if band.deletions else asked[owner] & rare)
        mine, s, part = owner[inside], flat[inside], parts[inside]
        segment = ((s >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        docs, rank = np.flatnonzero(asked), np.cumsum(asked) - 1
        cell = rank[mine] * segments + segment
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(s) else np.zeros(0, np.int64)
        total = np.add.reduceat(part, begins) if len(s) else part
        salt = np.uint64((number * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        place = segment.astype(np.uint64) + salt
        whole = B.mix(total ^ B.mix(place[begins]))
        absent = np.ones(len(docs) * segments, bool)
        absent[cell[begins]] = False
        gaps = np.flatnonzero(absent)
        missing, lacks = B.mix(B.mix((gaps % segments).astype(np.uint64) + salt)), docs[gaps // segments]
        sizes = np.diff(np.append(begins, len(s)))
        if band.deletions:
            rest = np.repeat(total, sizes) - part
            # an empty segment meets the deletion of a single element
            out += [whole, B.mix(rest ^ B.mix(place)), missing]
            of += [mine[begins], mine, lacks]
        else:
            every, whose = np.concatenate([missing, whole]), np.concatenate([lacks, mine[begins]])
            weakest = np.lexsort((every, whose << 32 | np.concatenate([np.zeros(len(missing), np.int64), sizes])))
            every, whose = every[weakest], whose[weakest]
            strong = np.arange(len(whose)) - np.searchsorted(whose, whose) >= spare
            out.append(every[strong])
            of.append(whose[strong])
    key, doc = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[once], np.arange(len(sets) + 1)).astype(np.int32)), pa.array(key[once].view(np.int64)))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether |a n b| * den >= |a u b| * num, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * den < len(b) * num:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * den >= (len(a) + len(b) - both) * num


def forest(sets: list[np.ndarray], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever links connect; sides: only pairs across different sides are compared, unless all are equal."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = [len(sets[i]) for i in order]
    across, out = len(set(sides)) > 1, []
    for x, i in enumerate(order):
        for y in range(x + 1, len(order)):
            if sizes[x] * den < sizes[y] * num:
                break
            j = order[y]
            if across and sides[i] == sides[j] or find(i) == find(j):
                continue
            if linked(sets[i], sets[j], num, den):
                root[find(i)] = find(j)
                out.append((i, j))
    return out


def _star(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with their smallest class, and the distinct links (2 x n) of the other classes to it."""
    order = np.lexsort((c, key))
    key, c = key[order], c[order]
    first = np.append(True, key[1:] != key[:-1])
    least = np.repeat(c[first], np.diff(np.append(np.flatnonzero(first), len(c))))
    far = c != least
    links = np.unique(np.stack([least[far], c[far]]), axis=1)
    return key[first], c[first], links


def _stars(sets: DataFrame, n: int) -> DataFrame:
    """a, b: links between classes that share a key, as stars."""

    def bundle(batches):
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            c = np.repeat(batch.column("c").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            key, c, links = _star(key, c)
            rows = list(ask(0, _KEYS, n, key, c.view(np.uint64)))
            if links.size:
                rows.append((int(links[0, 0] % n), 0, _LINKS, squeeze(links.ravel().view(np.uint64))))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in cols[:3]), pa.array(cols[3], pa.binary())], names=["part", "key", "kind", "blob"])

    def meet(bucket, held):
        links = [unsqueeze(blob, np.uint64).view(np.int64).reshape(2, -1) for _, kind, blob in held if kind == _LINKS]
        asked = [unpack_sorted(blob, np.uint64) for _, kind, blob in held if kind == _KEYS]
        if asked:
            links.append(_star(np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]).view(np.int64))[2])
        yield np.unique(np.concatenate(links, axis=1), axis=1)

    def make(rows):
        return pa.RecordBatch.from_pydict({"a": pa.array(rows[0][0]), "b": pa.array(rows[0][1])})

    return by_part(sets.select("c", "keys").mapInArrow(bundle, ROWS), n, meet, "a long, b long", make)


def _verify(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links a, b of the groups in `texts` (root, i, j, c, block, text), each group in one task."""

    def run(batches):
        name, seen = None, {}

        def flush():
            ids = list(seen)
            found = forest([seen[c][1] for c in ids], [seen[c][0] for c in ids], num, den)
            return pa.RecordBatch.from_pydict({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

        for part in slices(batches):
            groups = list(zip(*(part.column(x).to_pylist() for x in ("root", "i", "j"))))
            for g, c, block, s in zip(groups, part.column("c").to_pylist(), part.column("block").to_pylist(), word_sets(part.column("text"), k)):
                if g != name:
                    if seen:
                        yield flush()
                    name, seen = g, {}
                if c not in seen and class_of(s) == c:  # a class that comes again, as rows of a repeated doc_id do, is held once
                    seen[c] = block, s
        if seen:
            yield flush()

    placed = texts.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return placed.mapInArrow(releasing(run), "a long, b long")


def _blocks(n: str, size: str):
    return F.ceil(F.greatest(F.col(n) / BLOCK_SETS, F.col(size) / BLOCK_BYTES)).cast("int")


def _groups(docs: DataFrame, members: DataFrame, k: int, keys_of: Callable[[list[np.ndarray]], pa.ListArray]) -> DataFrame:
    """root, c, first, _blocks, block: the groups whose pairs are verified, named by a hash in `root`, and the block of each class in them.

    A component of one block is one group. A larger one is either a group of several blocks or, where that moves fewer bytes, a group for
    each key that classes of it share; keys shared by the same classes make one group. Both have all pairs that share a key."""
    salt = F.pmod(F.xxhash64("c"), F.lit(KEY_SALTS)).cast("int")
    sizes = members.groupBy("root").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b")).select("root", "_b", _blocks("_n", "_b").alias("_blocks"))
    placed = materialise(members.join(sizes, "root"), "placed")
    large = materialise(placed.where("_blocks > 1").select("root", "c", "first", "bytes"), "large")

    def describe(part):
        sets = [s if class_of(s) == c else s[:0] for s, c in zip(word_sets(part.column("text"), k), part.column("c").to_pylist())]
        yield {n: part.column(n) for n in ("root", "c", "first", "bytes")} | {"keys": keys_of(sets)}

    # made again from the texts, as all documents' keys would weigh more in a shuffle than their texts
    texts = docs.withColumnRenamed("doc_id", "first").join(large.hint("merge"), "first").select("root", "c", "first", "bytes", "text")  # grows with the corpus: never broadcast
    listed = map_slices(texts, f"root long, c long, first {dict(docs.dtypes)['doc_id']}, bytes long, keys array<long>", describe)
    held = materialise(listed.select("root", "c", "first", "bytes", F.explode("keys").alias("key")).distinct().withColumn("salt", salt), "held")
    named = held.groupBy("root", "key").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"), F.bit_xor(F.xxhash64("c")).alias("_x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("_y")).where("_n > 1")
    once = named.groupBy("root", "_n", "_b", "_x", "_y").agg(F.min("key").alias("key")).select("root", "key", "_b", _blocks("_n", "_b").alias("_blocks"))
    once = materialise(once, "once")
    moved = once.groupBy("root").agg(F.sum(F.col("_b").cast("double") * F.col("_blocks")).alias("_moved"))
    by_key = materialise(sizes.where("_blocks > 1").join(moved, "root").where("_moved < CAST(_b AS DOUBLE) * _blocks").select("root"), "by_key")
    spread = once.join(by_key, "root", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(KEY_SALTS - 1))))
    parts = held.join(spread.select("root", "key", "salt", "_blocks"), ["root", "key", "salt"]).withColumn("root", F.xxhash64("root", "key"))
    columns = ["root", "c", "first", "_blocks", F.pmod(F.xxhash64("c"), "_blocks").cast("int").alias("block")]
    groups = materialise(placed.join(by_key, "root", "left_anti").select(*columns).unionByName(parts.select(*columns)), "asked")
    for done in (placed, large, held, once, by_key):
        discard(done)
    return groups


def join(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document row."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    common = docs.sparkSession.sparkContext.broadcast(fit_on_texts(docs, lambda texts: common_of(texts, k), SAMPLE_DOCS, SAMPLE_BYTES))  # at most COMMON_MOST numbers

    def describe(part):
        sets = word_sets(part.column("text"), k)
        yield {
            "doc_id": part.column("doc_id"), "n": np.array([len(s) for s in sets], np.int64), "c": np.array([class_of(s) for s in sets], np.int64),
            "bytes": np.diff(B.flat(part.column("text"))[1]), "keys": key_lists(sets, num, den, common.value),
        }

    base = materialise(map_slices(docs, f"doc_id {kind}, n long, c long, bytes long, keys array<long>", describe), "sets")
    full = base.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # a class has at most SALTS rows here, so that its documents can be dealt out wherever they meet something of the class
    dealt = full.groupBy("c", "salt").agg(F.min("doc_id").alias("first"), F.max("bytes").alias("bytes"))
    classes = dealt.groupBy("c").agg(F.min("first").alias("first"), F.max("bytes").alias("bytes"))
    stars = _stars(full, number_of_blocks(docs))
    near = components(stars, "near")
    members = materialise(near.withColumnRenamed("node", "c").join(classes, "c"), "members")
    asked = _groups(docs, members, k, lambda sets: key_lists(sets, num, den, common.value))  # both joins with the texts are merge joins, at every size
    texts = docs.withColumnRenamed("doc_id", "first").join(asked.hint("merge"), "first").select("root", "c", "block", "_blocks", "text")
    pairs = texts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("root", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "c", "block", "text")
    links = materialise(_verify(pairs, k, num, den), "links")
    for done in (members, asked):
        discard(done)
    whole = components(links, "linked")
    ids = whole.withColumnRenamed("node", "c").join(classes.select("c", "first"), "c")
    best = ids.groupBy("root").agg(F.min("first").alias("component"))
    named = classes.select("c", "first").join(ids.join(best, "root").select("c", "component"), "c", "left").select("c", F.coalesce("component", "first").alias("component"))
    # Written first: the join with the documents then has no aggregation in its stage.
    named = materialise(dealt.select("c", "salt").join(named, "c"), "named")
    rows = base.select("doc_id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(named, ["c", "salt"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, with all their columns, of one document of each group: that with the smallest doc_id (then by a hash of the text).

    Documents without words are no group and stay; of rows with equal doc_id and text one stays."""
    key, rank = fresh(documents, "_row_key", "_row_rank")
    marked = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    rows = marked.select(F.struct("doc_id", F.col(key).alias("key")).alias("doc_id"), "text")
    kept = join(rows, k, num, den).where("component_id = doc_id").select(F.col("doc_id.key").alias(key)).distinct()
    order = Window.partitionBy(key).orderBy(key)
    once = marked.join(kept, key, "left_semi").withColumn(rank, F.row_number().over(order))
    return once.where(F.col(rank) == 1).select(*(F.col(f"`{c}`") for c in documents.columns))
