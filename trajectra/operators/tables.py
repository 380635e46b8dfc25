"""Tables that several passes read: written once, numbered, and with running sums, without one task holding all rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import wraps
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def own_folder(spark: SparkSession) -> str:
    """This application's folder for stored tables, under that of ``spark.checkpoint.dir``; an error where it is unset, as no other folder is known to be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share when the session is made")
    return f"{folder.rstrip('/')}/trajectra-tables/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once: a Parquet table in the folder of ``spark.checkpoint.dir``, which all executors share.

    A table that has been stored already is given back as it is. The tables go with :func:`release`, or with the folder's
    own retention.
    """
    if getattr(df, "_stored", False):
        return df
    spark = df.sparkSession
    path = f"{own_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = True
    return out


def not_sent_whole(df: DataFrame) -> DataFrame:
    """``df``, marked to be dealt out in joins: where like values take few bytes, files say little of a table's size in memory, and it would be taken for small enough to be sent to all tasks."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Delete this application's stored tables; call it once no result of them is still to be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reads_pairs_often(f: Callable) -> Callable:
    """An operator whose first argument, a pair table, is read by several passes: it is stored before."""

    @wraps(f)
    def inner(pairs: DataFrame, *rest, **options):
        return f(stored(pairs), *rest, **options)

    return inner


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str | Column]) -> DataFrame:
    """``df`` with running sums over all rows in ``order``, the row's own included; rows equal in ``order`` come in any order.

    Ranges are summed apart and then moved by what lies before them, of which there is a row per range.
    """
    values = {f"__v{i}": F.expr(v) if isinstance(v, str) else v for i, v in enumerate(sums.values())}
    ranged = stored(df.withColumns(values).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"__s{i}": F.sum(f"__v{i}").over(own) for i in range(len(sums))})
    parts = ranged.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("__part", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"__b{i}") for i, v in enumerate(values)])
    return local.join(F.broadcast(before), "__part").select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__s{i}") + F.col(f"__b{i}")).alias(name) for i, name in enumerate(sums)])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def shuffles(n: int, times: int, seed: int) -> list[tuple[int, int]]:
    """For each time (a, b) with a prime to n: place p takes what stands at (a p + b) mod n, a seeded order of n places."""
    import random

    rng = random.Random(f"{seed} {n}")
    out = []
    for _ in range(times):
        a = rng.randrange(1, max(2, n))
        while gcd(a, n) > 1:
            a = rng.randrange(1, max(2, n))
        out.append((a, rng.randrange(max(1, n))))
    return out
