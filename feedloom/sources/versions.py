"""State that batches of a stream leave for later ones: a table of versions in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Versions:
    """Rows by ``key``, where the last version's row of a key holds; an epoch's version has only
    the rows that it changed, and overwrites itself when the epoch is replayed, since an epoch reads
    only what stands before it.  Every ``fold`` epochs one holds all rows, and older ones are read
    no more.  A row with ``gone`` true takes its key out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], fold: int = 10):
        self.spark, self.path, self.key, self.fold = spark, path.rstrip("/"), key, fold
        self.schema = T._parse_datatype_string(schema)

    def _folder(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch:09d}"

    def before(self, epoch: int) -> DataFrame:
        """The rows as the epochs before this one left them."""
        kind = T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType())])
        if epoch == 0:
            return self.spark.createDataFrame([], self.schema)
        whole = (epoch - 1) // self.fold * self.fold  # the last epoch that holds all rows
        rows = self.spark.read.schema(kind).parquet(*(self._folder(e) for e in range(whole, epoch))).withColumn("_epoch", F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/epoch=", -1), "/", 1))
        last = Window.partitionBy(*self.key).orderBy(F.desc("_epoch"))
        return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1 and not gone").select(*self.schema.names)

    def write(self, changed: DataFrame, epoch: int) -> None:
        """The rows that ``epoch`` changed, each key once; a column ``gone`` may take keys out."""
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in changed.columns else F.lit(False)
        rows = changed.select(*self.schema.names, gone.alias("gone"))
        if epoch % self.fold == 0 and epoch:
            old = self.before(epoch).join(rows.select(*self.key), self.key, "left_anti")
            rows = old.withColumn("gone", F.lit(False)).unionByName(rows.where("not gone"))
        rows.write.mode("overwrite").parquet(self._folder(epoch))
