"""Tables of one row for each key, kept up to date batch by batch.

A table is a Parquet folder partitioned by one column. A batch's rows are compared with those that are there; what is new or differs goes, with the
place of the row that it replaces, to the log of changes of that batch, and then the partitions that are touched are rewritten by dynamic
overwrite. A batch that is given again finds its log and writes the same partitions again, so a run that was broken off can be repeated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at path; one without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def observed(metrics: Observation) -> dict[str, int]:
    """The metrics of an action that has ended; none where adaptive execution found no rows at all and left the plan out, metrics included."""
    try:
        return {k: v or 0 for k, v in metrics.get.items()}
    except Py4JJavaError:
        return {}


def rewrite(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that rows have, and no others; adaptive execution sizes the files, also where one partition holds most rows."""
    rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


@dataclass(frozen=True)
class Snapshot:
    """path: the table's folder; changes: that of the logs; same: the columns that tell whether a row has changed."""

    path: str
    changes: str
    schema: StructType
    key: str
    partition: str
    same: tuple[str, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows; those without a key only keep a partition that has lost all others."""
        return stored(spark, self.path, self.schema).where(F.col(self.key).isNotNull())

    def log(self, spark: SparkSession, batch: int | str | None = None) -> DataFrame:
        """The changes of a batch, or of all: the rows, their action (add or update) and `was`, the partition of the row replaced."""
        fields = StructType(list(self.schema.fields)).add("action", "string").add("was", self.schema[self.partition].dataType)
        return stored(spark, f"{self.changes}/batch={batch}", fields) if batch is not None else stored(spark, self.changes, fields.add("batch", "string"))

    def classified(self, rows: DataFrame) -> DataFrame:
        """rows with action (add, update, skip) and was. Rows without a key are left out; of several with one key the largest by `same` counts."""
        names = [f.name for f in self.schema]
        rows = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(*self.same, F.to_json(F.struct(*names)))).alias("_row")).select("_row.*")
        old = self.read(rows.sparkSession).select(self.key, F.col(self.partition).alias("was"), F.struct(*self.same).alias("_old"))
        action = F.when(F.col("_old").isNull(), "add").when(F.col("_old").eqNullSafe(F.struct(*self.same)), "skip").otherwise("update")
        return rows.join(old, self.key, "left").select(*names, action.alias("action"), "was")

    def apply(self, rows: DataFrame, batch: int | str) -> tuple[DataFrame, dict[str, int]]:
        """Takes the rows of a batch in; returns the partitions that were touched, as a table of one column read from the log, and the numbers of
        rows by action (without skip where the batch was given before)."""
        spark, log = rows.sparkSession, self.log(rows.sparkSession, batch)
        if log.isEmpty():
            seen = Observation()
            counted = self.classified(rows).observe(seen, *(F.count_if(F.col("action") == a).alias(a) for a in ("add", "update", "skip")))
            counted.where("action <> 'skip'").write.mode("overwrite").parquet(f"{self.changes}/batch={batch}")
            log, actions = self.log(spark, batch), observed(seen)
        else:
            actions = {r.action: r["count"] for r in log.groupBy("action").count().collect()}  # two at most
        touched = log.select(self.partition).union(log.where("action = 'update'").select("was")).distinct()
        here = _equal(self.partition)
        kept = self.read(spark).alias("a").join(touched.alias("b"), here, "left_semi").join(log.select(self.key), self.key, "left_anti")
        rows = kept.select(self.schema.names).unionByName(log.select(self.schema.names)).unionByName(touched, allowMissingColumns=True)
        rewrite(rows.select(self.schema.names), self.path, self.partition)
        return touched, {a: actions.get(a, 0) for a in ("add", "update", "skip")}

    def within(self, spark: SparkSession, touched: DataFrame) -> DataFrame:
        """The rows of the touched partitions."""
        return self.read(spark).alias("a").join(touched.alias("b"), _equal(self.partition), "left_semi")


def _equal(column: str) -> Column:
    return F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))


def stream_path(path: str) -> str:
    """A streaming source lists folders: a table of a single file is given as a pattern of its own name."""
    return f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path


def follow(spark: SparkSession, source: str, schema: StructType | str, checkpoint: str, handle: Callable[[DataFrame, int], None], max_files: int | None = None) -> None:
    """Gives what is new in a Parquet folder since the checkpoint to `handle`, batch by batch, and waits."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = reader.parquet(stream_path(source)).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


