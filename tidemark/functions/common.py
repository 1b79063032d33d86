"""Small helpers every operator shares: sizes, names, lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

US_SECOND = 1_000_000
US_HOUR = 3_600 * US_SECOND
US_DAY = 24 * US_HOUR

#: Bytes a table may have at most to be broadcast by ``sized_join``.
BROADCAST_BYTES = 8 << 20
#: A join key counts as hot from this many rows, or from a 2,000th of all rows if that is more (so at most 2,000 are hot).
HOT_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where that is unset, a temporary one, but only if driver
    and executors are one process (``local[...]``): on a cluster they couldn't share it, so there it is an error."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    # a checkpoint goes once no DataFrame refers to it any more
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs no recomputation from the start."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame | Sequence[str], stem: str) -> str:
    """A column name that the frame doesn't have yet (extra columns may clash with any fixed name)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def spread_over(df: DataFrame, parts: Column) -> Column:
    """A part number for each row, from its hashable columns and the partition it lies in (so that copies spread too); the
    same whenever a task is repeated."""
    plain = [c for c, k in df.dtypes if "map<" not in k and "variant" not in k]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.spark_partition_id()), parts).cast("int")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    size = F.lit(16)
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(x), F.lit(0)) + 24
        elif "<" in kind:
            size = size + F.coalesce(F.length(F.to_json(F.struct(x))), F.lit(0)) + 24
        else:
            size = size + 8
    return size.cast("long")


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table (one that is written already) may be broadcast, and anything of it that has no more rows and columns."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def small_join(big: DataFrame, small: DataFrame, keys: Sequence[str], fit: bool, how: str = "left") -> DataFrame:
    """``sized_join`` where it is known already whether the small side fits (it comes from a table that does)."""
    return big.join(F.broadcast(small), list(keys), how) if fit else sized_join(big, small, keys, how)


def sized_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a derived table (one row per key) to a big one whose keys may be skewed.

    The small side is written and its bytes are counted. Up to ``limit`` it is broadcast. Beyond, both sides are shuffled by
    the keys; the big side's rows per key are counted, and only keys with more than ``hot_rows`` of them (and more than a
    2,000th of all) are spread over several tasks, each with its own copy of the key's row. Null keys match nothing; they are
    spread like others.
    """
    small = cut(small)
    if fits(small, limit):
        return big.join(F.broadcast(small), list(keys), how)
    k = [F.col(f"`{c}`") for c in keys]
    sizes = cut(big.groupBy(*k).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows))
    total = big.count() if not sizes.isEmpty() else 0
    least = max(hot_rows, total // 2000)
    hot = sizes.filter(F.col("_rows") > least)
    if hot.isEmpty():
        return big.join(small.hint("merge"), list(keys), how)
    names = list(big.columns) + list(small.columns)
    salt, parts = fresh(names, "_salt"), fresh(names, "_parts")
    own = [fresh(names, f"_hot{i}") for i in range(len(keys))]
    hot = F.broadcast(hot.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keys, own)], F.ceil(F.col("_rows") / least).cast("int").alias(parts)))

    def with_parts(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c, o in zip(keys, own):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(o))
        return df.join(hot, same, "left").drop(*own).withColumn(parts, F.coalesce(F.col(parts), F.lit(1)))

    spread = with_parts(big).withColumn(salt, spread_over(big, F.col(parts))).drop(parts)
    copies = with_parts(small).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return spread.join(copies.hint("merge"), [*keys, salt], how).drop(salt)


def floordiv(a: Column, b: int) -> Column:
    """Floor division of a BIGINT without passing through DOUBLE."""
    by = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, by), by)


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a frame of at most one row to every row (null if it has none).

    The join is on a constant, which Spark folds away: the plan shows a nested-loop join with a broadcast of one row, whose
    output is as long as ``df``.
    """
    k = fresh([*df.columns, *one.columns], "_one")
    return df.withColumn(k, F.lit(0)).join(F.broadcast(one.limit(1).withColumn(k, F.lit(0))), k, "left").drop(k)


def local_day(us: Column, zone: str) -> Column:
    """Day number (days since 1970-01-01) of an instant in a zone; independent of the session's zone."""
    return floordiv(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)), US_DAY).cast("int")


def day_text(day: Column) -> Column:
    """Day number to ``YYYY-MM-DD``."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")
