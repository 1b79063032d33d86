"""Mixing sources to target weights (problem 8), by systematic sampling.

A source's documents are expected ``rate`` = min(max_repeats, target tokens / tokens of the source) times each. They stand in
order of their size class (a sixteenth of a doubling), within it in a random but fixed order, and their expected copies
are summed up; with one random offset per source a document is emitted once per integer boundary that the sum crosses, so
at most ``ceil(rate)`` <= max_repeats times. The copies of any stretch of a source differ from their expectation by less
than one document, so large and small documents are drawn alike, and the tokens used differ from those expected by little
more than one of the largest documents (tested: 1 % of the target and twice the largest document). The prefix sums go by buckets: a source of any size
is spread over them, and only one row per bucket and source is summed in order.

Results for odd input: sources that aren't in the targets take no part; a target without documents stays at 0 and is
short; null or empty texts have 0 tokens and are copied like others; a null source matches no target; repeated targets of
one source are added up, with the least of their repeats; shares that don't add up to 1 are used as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import attach_row, cut, sized_join

BUCKET_ROWS = 20_000
#: Size classes of documents per doubling of their tokens.
SIZE_CLASSES = 16


def clean_targets(targets: DataFrame) -> DataFrame:
    return targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def source_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its tokens, the tokens wanted, what max_repeats allows, the rate, and whether it falls short."""
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    rates = clean_targets(targets).join(sums, "source", "left").fillna(0, ["tokens", "documents"])
    # one row per target source; the total over them is joined as a single row
    total = rates.agg(F.sum("tokens").alias("total"))
    rates = attach_row(rates, total).withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("reach", F.col("tokens") * F.col("max_repeats"))
    rate = F.least(F.col("max_repeats").cast("double"), F.coalesce(F.try_divide("wanted", "tokens"), F.lit(0.0)))
    return rates.withColumn("rate", rate).withColumn("short", F.col("reach") < F.col("wanted"))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", keep: Sequence[str] = (), seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sized`` (key, source, tokens) with ``copies``, the number of times each document is used (0 too)."""
    sized = cut(sized)
    rates = cut(source_rates(sized, targets))
    own = sized_join(sized, rates.select("source", "rate"), ["source"], "inner").withColumns({"_h": F.xxhash64(F.col(key), F.lit(seed)), "_size": F.floor(F.log2(F.col("tokens") + 1) * SIZE_CLASSES)})
    parts = own.groupBy("source", "_size").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_parts"))
    own = sized_join(own, parts, ["source", "_size"]).withColumn("_bucket", F.struct("_size", F.pmod(F.xxhash64("_h"), F.col("_parts")).alias("part"))).drop("_size", "_parts")
    sums = own.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = sized_join(own, sums, ["source", "_bucket"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_h", key))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    upto = lambda n: F.floor(n * F.col("rate") + offset + F.lit(1e-9))
    own = own.withColumn("_place", place).withColumn("copies", (upto(F.col("_place")) - upto(F.col("_place") - 1)).cast("int"))
    return own.select(key, "source", *keep, "tokens", "copies")


def reached(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: target and actual share of the mix, tokens wanted and used, the least and greatest number of
    copies, and ``short``: every document stands in the mix ``max_repeats`` times and still less is used than wanted."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.min("copies").alias("least_copies"), F.max("tokens").alias("largest"))
    out = rates.drop("short").join(used, "source", "left").fillna(0, ["used", "most_copies", "largest"])
    total = out.agg(F.sum("used").alias("all_used"))
    short = F.coalesce(F.col("least_copies") >= F.col("max_repeats"), F.lit(True)) & (F.col("used") < F.col("wanted"))
    return attach_row(out, total).select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("used").cast("double"), "all_used"), F.lit(0.0)).alias("actual_share"), "tokens", "wanted", "used", "largest", "max_repeats", "most_copies", short.alias("short")
    )
