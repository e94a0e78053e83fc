"""What the operators share: tables, held-out folds, the shared scratch folder, Arrow slices."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once (one longer text still goes whole).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_model(name: str) -> str:
    """The path of a public tokenizer's file, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and there is but one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='skyquarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_WRITTEN = "_skyquarry_path"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _WRITTEN, path)
    return out


def discard(df: DataFrame) -> None:
    """Deletes what `materialise` wrote for df, once nothing that is still to run reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(df, _WRITTEN))
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts have at most `limit` bytes together, or of one row."""
    for batch in batches:
        texts = batch.column(column)
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks and share an executor's memory with those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that releases memory when its task has ended."""

    def to_the_end(batches):
        yield from run(batches)
        release()

    return to_the_end


def map_slices(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterable[dict]], column: str = "text", finish: Callable[[], None] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of `limit` bytes; `work` yields dicts of columns for one slice, `finish` runs at the end of a task (workers outlive their tasks)."""
    names = [f.name for f in _parsed(df.sparkSession, schema)]

    def run(batches):
        try:
            for part in slices(batches, column, limit):
                for out in work(part):
                    yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)
        finally:
            if finish:
                finish()

    return df.mapInArrow(releasing(run), schema)


def filter_slices(df: DataFrame, keep: Callable[[pa.RecordBatch], Any], column: str = "text") -> DataFrame:
    """The rows of df, all columns unchanged, for which `keep` gives True; keep: a slice -> booleans."""

    def run(batches):
        for part in slices(batches, column):
            yield part.filter(pa.array(keep(part), pa.bool_()))

    return df.mapInArrow(releasing(run), df.schema)


def _parsed(spark, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def bounded_sample(labelled: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows with the smallest hashes: a sample of at most `rows` rows that does not depend on partitioning."""
    return labelled.withColumn("_order", F.xxhash64(key)).orderBy("_order", key).limit(rows).drop("_order")


def fit_on_sample(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, fit: Callable[[list[str], list[int]], Any], max_docs: int, max_bytes: int = 60_000) -> Any:
    """Fits a model of document labels in one executor task on a bounded sample, and returns it.

    The sample: of the ids that `allowed` admits, that carry a label and have a text of at most `max_bytes` bytes, the `max_docs` with the smallest
    hashes; of a repeated id the smallest such text. Rows are sorted first, so the model doesn't depend on partitioning."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")).where(allowed)
    picked = bounded_sample(known.join(texts.select("doc_id"), "doc_id", "left_semi"), F.col("doc_id"), max_docs)

    def run(batches):
        rows = sorted((str(i), t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_y"))))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())})

    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # picked has at most max_docs rows of two numbers
    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], [])  # an empty table may have no task at all


def fit_on_texts(documents: DataFrame, fit: Callable[[list[str]], Any], max_docs: int, max_bytes: int) -> Any:
    """What `fit` makes, in one executor task, of about `max_docs` distinct texts of at most `max_bytes`, chosen by the hash of doc_id and text."""
    share = min(1.0, max_docs / max(1, documents.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) <= int(share * (1 << 40))
    texts = documents.where(F.col("doc_id").isNotNull() & chosen & (F.octet_length("text") <= max_bytes)).select("text").distinct()

    def run(batches):
        rows = sorted(t for b in batches for t in b.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    made = texts.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([])  # an empty table may have no task at all
