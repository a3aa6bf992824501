"""Dictionaries that grow with a stream: a code, once given, stays.

A dictionary is a folder of versions, one for each batch, with the values that the batch saw first.  A batch that is run again, after a failure
or from an older checkpoint, finds its version written and adds nothing; a version that was cut off is written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.operators import encode


class GrowingDictionary:
    """Codes of ``column`` in ``path``, numbered by first appearance: batches in order, and ``order`` within."""

    def __init__(self, spark: SparkSession, path: str, column: str, order: str = "aln_idx"):
        self.spark, self.path, self.column, self.order = spark, path.rstrip("/"), column, order

    def versions(self) -> list[int]:
        """The batches whose versions are whole."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        names = [x.getPath().getName() for x in store.listStatus(root)]
        whole = lambda n: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and whole(n))

    def _at(self, batch: int) -> str:
        return f"{self.path}/batch-{batch}"

    def words(self, before: int | None = None) -> DataFrame | None:
        """(value, code) of all batches, or of those before one; None without any."""
        known = [self._at(b) for b in self.versions() if before is None or b < before]
        return self.spark.read.parquet(*known) if known else None

    def extend(self, batch: DataFrame, number: int) -> None:
        """Add what the batch of this number is the first to hold."""
        if number in self.versions():
            return
        known = self.words(number)
        size = 0 if known is None else known.count()
        rows = batch if known is None else batch.join(known, batch[self.column].eqNullSafe(known["value"]), "left_anti")
        new = encode.first_seen(rows.withColumnRenamed(self.order, "aln_idx") if self.order != "aln_idx" else rows, self.column)
        new.select("value", (F.col("code") + size).cast("int").alias("code")).write.mode("overwrite").parquet(self._at(number))

    def encode(self, rows: DataFrame, out: str = "code") -> DataFrame:
        """Add the codes; a value that no batch has seen has none."""
        words = self.words().select("value", F.col("code").alias(out))
        return rows.join(words, rows[self.column].eqNullSafe(words["value"]), "left").drop("value")

    def follow(self, stream: DataFrame, checkpoint: str):
        """A query that extends the dictionary with each batch of what there is now; wait for it to end."""
        return stream.writeStream.foreachBatch(self.extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
