"""Tables of rows by item that are merged bucket by bucket.

A store holds the rows of many runs: a folder per run, and in each folder one file per bucket
of the item id, sorted. Spark reads a bucket of all runs in one task, so picking the newest row
of each key, or joining with the items, moves no stored row; only what is new is dealt to the
buckets when it is written. The number of buckets is fixed when a store is made (as many as
shuffle partitions, unless given) and kept beside the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

RUN = "run_id"


@dataclass(frozen=True)
class Store:
    """``keys``: what a row is the newest of, the item id first. ``newest``: the column that tells."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    newest: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str, keys: Sequence[str], newest: str,
             buckets: int | None = None) -> Store:
        """The store at ``path``; made if there is none."""
        layout = f"{path}/layout"
        try:
            row = spark.read.schema("buckets int, columns string").json(layout).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        made = row is None
        if made:
            count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(count, schema)], "buckets int, columns string").coalesce(1).write.mode(
                "overwrite").json(layout)
            row = (count, schema)
        if buckets not in (None, row[0]):
            raise ValueError(f"{path} has {row[0]} buckets, not {buckets}")
        store = cls(spark, path, row[1], tuple(keys), newest, row[0])
        store._register()
        if made:  # a folder of no rows, so that there is one to look for runs in
            store.put(spark.createDataFrame([], schema), 0)
        spark.catalog.recoverPartitions(store.table)
        return store

    @property
    def table(self) -> str:
        """Its name in this session: a catalogue entry is how Spark is told of buckets."""
        return "store_" + hashlib.sha1(self.path.encode()).hexdigest()[:20]

    def _register(self) -> None:
        kinds = T.StructType.fromDDL(self.schema)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}, {RUN} bigint) USING parquet "
            f"PARTITIONED BY ({RUN}) CLUSTERED BY ({self.keys[0]}) SORTED BY ({', '.join(self.keys)}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """New rows, in the partitions that the stored ones have."""
        return rows.repartition(self.buckets, self.keys[0])

    def put(self, rows: DataFrame, run_id: int) -> None:
        """Write a run's rows; a run that is repeated replaces itself, also with nothing."""
        names = T.StructType.fromDDL(self.schema).names
        run = f"{RUN} = {int(run_id)}"
        self.dealt(rows.select(*names)).createOrReplaceTempView(f"{self.table}_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION ({run}) SELECT * FROM {self.table}_new")
        self.spark.catalog.dropTempView(f"{self.table}_new")

    def rows(self) -> DataFrame:
        """All rows of all runs, with their run."""
        return self.spark.table(self.table)

    def merged(self, more: DataFrame | None = None) -> DataFrame:
        """The newest row of each key; rows of ``more`` count as a later run's.

        Of equally new rows the later run's goes first.
        """
        names = T.StructType.fromDDL(self.schema).names
        rows = self.rows()
        if more is not None:
            late = self.dealt(more.select(*names)).withColumn(RUN, F.lit(None).cast("bigint"))
            rows = rows.unionByName(late)
        order = Window.partitionBy(*self.keys).orderBy(
            F.col(self.newest).desc_nulls_last(), F.col(RUN).desc_nulls_first())
        return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*names)
