"""What operators need of the cluster: reliable checkpoints in its shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a join that are looked up by broadcast. A key of over 1/1000 of the rows is always among them.
HOT_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Only a local session that names none gets one of its own, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    A checkpoint keeps the size that the optimizer estimated, for a join the product of its sides. Where each step joins
    what the last ones made, the digits of that number double from step to step until they fill the driver's heap. So the
    estimate is cut off too; adaptive execution goes by the sizes that it meets.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept, sql = df.checkpoint(eager=True)._jdf, spark._jvm.org.apache.spark.sql
    rows = kept.queryExecution().analyzed()
    none = spark._jvm.scala.Option.apply(None)
    plan = sql.execution.LogicalRDD(rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what is at ``path``, in whatever store that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key; the keys' names are columns of both.

    Keys that may hold a large share of the rows (the ``HOT_KEYS`` most frequent ones, so every key of over a
    thousandth) are looked up by broadcast, at most that many rows of ``table``; all others meet in a shuffle. So no task
    gets the rows of one key, however many they are. Null keys are like absent ones.
    """
    (mark,) = unused(rows, "found_hot")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hot = rows.where(known).groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(HOT_KEYS).select(*keys)
    hot = hot.withColumn(mark, F.lit(True))
    own = table.join(F.broadcast(hot.drop(mark)), keys, "left_semi")
    marked = rows.join(F.broadcast(hot), keys, "left")
    first = marked.where(F.col(mark)).drop(mark).join(F.broadcast(own), keys, how)
    rest = marked.where(F.col(mark).isNull()).drop(mark)
    return first.unionByName(rest.join(table, keys, how))
