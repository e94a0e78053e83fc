"""Document fingerprints by SimHash, in DataFrame operations alone.

Terms are runs of three words (lower-cased, divided by white space; the whole sequence where there are fewer). A term that occurs n
times has the weight 1 + floor(log2(n)), so that no term of a repetitive text outvotes all others. A term has 128 hash bits; each
bit position sums the weights of the terms whose bit is set, and the fingerprint has a bit where more than half of the weight votes for it. Two positions are counted in one sum, in lanes of 32 bits. Likeness of two
fingerprints is the share of equal bits.

`within` finds all fingerprints within a Hamming radius r of given ones: the 128 bits are cut into blocks, and for every choice of
blocks - r there is a table keyed by the permuted leading blocks; two fingerprints that differ in at most r bits agree
on at least one choice. Candidates are verified by counting bits.

Defined results: null and empty texts have no terms and the fingerprint zero; equal texts have equal fingerprints; rows with a
repeated or null doc_id keep a row each, and as a "next" document a repeated id stands for one of its texts, that with the smallest (hash,
length), for the edit as for the likeness; a null doc_id has no next document and counts as its own; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

WORDS = 3
BITS = 128
_BLANK = " \t\n\x0b\f\r"
_SECOND = 0x5DEECE66D
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def words_of(text: Column) -> Column:
    """The words of a text, as array<string>; a single empty one without words."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANK)), r"[\x20\x09-\x0D]+")


def terms(words: Column) -> Column:
    """The term hashes, as array<long>; empty without words. `words` must be a column of the input, or the lambda computes it for each term."""
    n = F.size(words)
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    at = lambda i, k: F.get(words, i + k)
    many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(at(i, k) for k in range(WORDS))))
    return F.when((n == 1) & (F.get(words, F.lit(0)) == ""), F.expr("cast(array() as array<bigint>)")).when(n < WORDS, whole).otherwise(many)


def weighted(ordered: Column) -> Column:
    """The distinct terms of a sorted array with their weights, as array<struct<t, w>>. `ordered` must be a column of the input."""
    n = F.size(ordered)
    at = lambda i: F.get(ordered, i)

    def weight(i: Column, h: Column) -> Column:
        w = F.lit(31)
        for m in range(30, 0, -1):  # the m-th power of two is reached where the element 2^m - 1 places on is the same
            w = F.when(F.coalesce(at(i + ((1 << m) - 1)) == h, F.lit(False)), w).otherwise(F.lit(m))
        return w

    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i - 1) != at(i)))
    return F.when(n > 0, F.transform(starts, lambda i: F.struct(at(i).alias("t"), weight(i, at(i)).cast("long").alias("w")))).otherwise(F.expr("cast(array() as array<struct<t:bigint,w:bigint>>)"))


def _vote(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Fingerprints (columns f0, f1, 64 bits each) of the distinct `keys`, and how many rows have them (_rows).

    Rows with equal keys have equal words: their votes are multiplied, which leaves the majority as it is."""
    # each array is a column before a lambda refers to it, or it would be computed for every element
    ordered = df.select(*keys, F.sort_array(terms(F.col(words))).alias("_a"))
    exploded = ordered.select(*keys, F.posexplode_outer(weighted(F.col("_a"))).alias("_i", "_e")).select(*keys, F.when(F.coalesce("_i", F.lit(0)) == 0, 1).alias("_one"), F.col("_e.t").alias("_t"), F.col("_e.w").alias("_w"))
    first, second = F.col("_t"), F.xxhash64(F.col("_t"), F.lit(_SECOND))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES)) * F.col("_w")).alias(f"s{k}_{i}") for k, h in enumerate((first, second)) for i in range(32)]
    voted = exploded.groupBy(*keys).agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("_n"), F.sum("_one").alias("_rows"), *sums)

    def half(k: int) -> Column:
        word = F.lit(0).cast("long")
        for i in range(32):
            s = F.coalesce(F.col(f"s{k}_{i}"), F.lit(0))
            for shift, lane in ((i, s.bitwiseAND(F.lit(_LOW))), (i + 32, F.shiftrightunsigned(s, 32))):
                bit = (1 << shift) if shift < 63 else -(1 << 63)
                word = word.bitwiseOR(F.when(lane * 2 > F.col("_n"), F.lit(bit)).otherwise(F.lit(0).cast("long")))
        return word

    return voted.select(*keys, "_rows", half(0).alias("f0"), half(1).alias("f1"))


def _shown(f0: Column, f1: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / float(BITS)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_sha256, fingerprint (hex), f0, f1: one row for each distinct pair of doc_id and text."""
    base = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), words_of(F.col("text")).alias("_words"))
    return _vote(base, ["doc_id", "text_sha256"], "_words").drop("_rows").withColumn("fingerprint", _shown(F.col("f0"), F.col("f1")))


def successors(documents: DataFrame) -> DataFrame:
    """doc_id, next_id of the distinct ids in ascending order; the last one's next is the first."""
    ids = documents.select("doc_id").where("doc_id is not null").distinct()
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(ids.repartitionByRange(n, "doc_id").withColumn("_p", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("_p").agg(F.min("doc_id").alias("_first"))  # a row for each range: at most n
    order = Window.orderBy("_p")
    after = firsts.select("_p", F.coalesce(F.lead("_first").over(order), F.first("_first").over(order)).alias("_after"))
    inside = ranged.withColumn("_next", F.lead("doc_id").over(Window.partitionBy("_p").orderBy("doc_id")))
    return inside.join(F.broadcast(after), "_p").select("doc_id", F.coalesce("_next", "_after").alias("next_id"))


def with_edits(documents: DataFrame) -> DataFrame:
    """The rows of documents with n_chars, and the edited text: the last floor(n_chars / 4) code points replaced by the first as many of the next document.

    Columns: doc_id, _text (a hash of the text), text, n_chars, next_id, edited."""
    every = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = every.where("doc_id is not null").repartition(n, "doc_id")  # the texts are dealt out once, for both joins
    after = successors(documents)
    # What a row needs of its next document is a quarter of its own length, so only such prefixes travel.
    needs = every.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("_most")).join(after, "doc_id").select(F.col("doc_id").alias("_for"), "next_id", F.floor(F.col("_most") / 4).cast("int").alias("_take"))
    stands = F.struct(F.xxhash64("text"), F.char_length("text"))
    heads = docs.join(needs, F.col("doc_id") == F.col("next_id")).groupBy("_for", "next_id").agg(F.min_by(F.expr("substring(text, 1, _take)"), stands).alias("_head"))
    joined = docs.join(heads.withColumnRenamed("_for", "doc_id"), "doc_id")
    nameless = every.where("doc_id is null").withColumns({"next_id": F.col("doc_id"), "_head": F.col("text")})
    joined = joined.unionByName(nameless).withColumn("n_chars", F.char_length("text").cast("long"))
    take = F.floor(F.col("n_chars") / 4).cast("int")
    return joined.withColumn("_k", take).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - _k), substring(_head, 1, _k))")).select("doc_id", F.xxhash64("text").alias("_text"), "text", "n_chars", "next_id", "edited")


def compare_edits(documents: DataFrame, asks: Column | None = None, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each document row.

    asks: a condition on doc_id; the rows that meet it also get n_within, how many rows (they included) have a fingerprint within
    `radius` bits of theirs (null for the other rows)."""
    rows = with_edits(documents)
    sides = F.array(F.struct(F.lit(False).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(True).alias("edit"), F.col("edited").alias("t")))
    keys = ["doc_id", "_text", "n_chars", "next_id", "edited_sha256", "edit"]
    both = rows.select("doc_id", "_text", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"), F.explode(sides).alias("s"))
    worded = both.select(*keys[:-1], "s.edit", words_of(F.col("s.t")).alias("_words"))
    voted = _vote(worded, keys, "_words")
    pick = lambda edit, c: F.max(F.when(F.col("edit") == edit, F.col(c)))
    wide = materialise(voted.groupBy(*keys[:-1]).agg(F.max("_rows").alias("_rows"), *(pick(e, f"f{k}").alias(f"{n}{k}") for e, n in ((False, "f"), (True, "e")) for k in (0, 1))), "simhash")
    last = wide.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by(F.struct("f0", "f1"), F.struct("_text", "n_chars")).alias("_last"))
    joined = wide.join(last.select("next_id", F.col("_last.f0").alias("n0"), F.col("_last.f1").alias("n1")), "next_id", "left")
    extra = []
    if asks is not None:
        found = near_counts(wide.where(asks).select("f0", "f1"), wide.select("f0", "f1", "_rows"), radius)
        joined = joined.join(found, ["f0", "f1"], "left")
        extra = [F.when(asks, F.col("n_within")).alias("n_within")]
    # repeated rows again, in two steps so that no array grows long
    step = 1 << 12
    joined = joined.withColumn("_m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / step)))).withColumn("_m", F.explode(F.sequence(F.lit(1), F.least(F.lit(step), F.col("_rows") - F.col("_m") * step).cast("int"))))
    f, e, n = (tuple(F.coalesce(F.col(f"{x}{k}"), F.col(f"f{k}")) for k in (0, 1)) for x in "fen")
    return joined.select("doc_id", "n_chars", "edited_sha256", _shown(*f).alias("fingerprint"), _shown(*e).alias("edited_fingerprint"), likeness(f, e).alias("near_edited"), likeness(f, n).alias("near_next"), *extra)


def _block(j: int, width: int, names: tuple[str, str] = ("f0", "f1")) -> Column:
    word, shift = divmod(j * width, 64)
    return F.shiftrightunsigned(F.col(names[word]), shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _close(asked: DataFrame, classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """q0, q1, the columns of `classes` (f0, f1 and others) and the distance of all pairs within the radius, each once.

    A table for each choice of blocks - radius blocks; a pair is taken from the first table whose blocks agree."""
    width = BITS // blocks
    if blocks <= radius or BITS % blocks or width > 64:
        raise ValueError("blocks must divide 128, exceed the radius, and have 64 bits at most")
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        tables = [F.struct(F.lit(t).alias("table"), F.xxhash64(*(_block(j, width, names) for j in chosen)).alias("key")) for t, chosen in enumerate(choices)]
        return df.withColumn("_k", F.explode(F.array(*tables))).select("*", "_k.table", "_k.key").drop("_k")

    differ = [F.col("f0").bitwiseXOR(F.col("q0")), F.col("f1").bitwiseXOR(F.col("q1"))]
    same = lambda j: F.shiftrightunsigned(differ[j * width // 64], j * width % 64).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)) == 0
    first = None
    for t, chosen in enumerate(choices):
        agree = F.lit(True)
        for j in chosen:
            agree = agree & same(j)
        first = F.when(agree, t) if first is None else first.when(agree, t)
    distance = F.bit_count(differ[0]) + F.bit_count(differ[1])
    met = keyed(asked, ("q0", "q1")).join(keyed(classes, ("f0", "f1")), ["table", "key"])
    return met.where((distance <= radius) & (first == F.col("table"))).withColumn("distance", distance).drop("table", "key")


def near_counts(asked: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """f0, f1, n_within: for each distinct fingerprint asked for (f0, f1), the rows of `prints` (f0, f1, _rows: how many rows it stands for) within the radius."""
    classes = prints.groupBy("f0", "f1").agg(F.sum("_rows").alias("_rows"))
    questions = asked.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    return _close(questions, classes, radius, blocks).groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("_rows").alias("n_within"))


def within(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """query_id, doc_id, distance: all fingerprints of `prints` (doc_id, f0, f1) within `radius` bits of those of `queries` (the same columns).

    `blocks` divides 128 and exceeds `radius`. Rows of `prints` with equal fingerprints travel as one class and are joined back at the end, so a
    large group of copies meets a query once."""
    classes = prints.select("f0", "f1").distinct()
    asked = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    close = _close(asked, classes, radius, blocks)
    named = queries.select(F.col("doc_id").alias("query_id"), F.col("f0").alias("q0"), F.col("f1").alias("q1")).join(close, ["q0", "q1"])
    return named.join(prints.select("doc_id", "f0", "f1"), ["f0", "f1"]).select("query_id", "doc_id", "distance")
