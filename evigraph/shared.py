"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder below the warehouse on a single
    machine; a cluster must name one, since the default warehouse is a machine's own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and that no frame still to be computed reads."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(t.table_path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
