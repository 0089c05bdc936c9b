"""Column statistics and MaxDiff histograms, as aggregations."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import with_neighbours
from tessera.operators.verify import BadSemantic, fields_exist, kind
from tessera.sources.scratch import stored


def column_statistics(df: DataFrame, *fields: str) -> DataFrame:
    """One row per field: rows, distinct values, least and greatest value (as strings). One pass over df."""
    wanted = [f(c).alias(f"{n}_{k}") for k, c in enumerate(fields) for n, f in (("n", F.count), ("d", F.count_distinct), ("low", F.min), ("high", F.max))]
    row = df.agg(*wanted)
    each = [row.select(F.lit(c).alias("field"), F.col(f"n_{k}").alias("n_rows"), F.col(f"d_{k}").alias("n_distinct"), F.col(f"low_{k}").cast("string").alias("low"), F.col(f"high_{k}").cast("string").alias("high")) for k, c in enumerate(fields)]
    return reduce(DataFrame.unionByName, each)


def equi_join_size(left: DataFrame, left_field: str, right: DataFrame, right_field: str) -> DataFrame:
    """One row, n_rows: how many rows an equi-join gives. Each side is counted by key first, so a hot key costs one row a side and not the product."""
    a = left.groupBy(F.col(left_field).alias("k")).agg(F.count("*").alias("a"))
    b = right.groupBy(F.col(right_field).alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_rows"))


def _valued(df: DataFrame, field: str) -> DataFrame:
    """(v, n) of every value that isn't null, with its neighbours; written, as each cut reads it again."""
    return stored(with_neighbours(df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("v")).agg(F.count("*").alias("n")), "v", "n"), "values")


def maxdiff_histogram(df: DataFrame, field: str, buckets: int = 20, percentiles: int = 5) -> DataFrame:
    """MaxDiff(V, F) buckets of a field: frequency, low, high, distinct, and the values at equal shares of the distinct ones.

    Values stand in order with their frequencies, and the buckets are cut where neighbours' frequencies differ
    most, at the smaller value on ties. All rows are counted, by value; values are ordered in ranges, and only
    the cuts, one less than there are buckets, come to the driver.
    """
    fields_exist(df, field)
    values = _valued(df, field)
    step = F.abs(F.col("n") - F.col("_last_n"))
    cuts = values.where("_last_n IS NOT NULL").orderBy(F.desc(step), "v").limit(buckets - 1).select("_rank").collect()
    number = reduce(add, [(F.col("_rank") >= r[0]).cast("int") for r in cuts], F.lit(0))
    placed = values.withColumn("_bucket", number)
    of = placed.groupBy("_bucket").agg(F.min("_rank").alias("_begin"), F.count("*").alias("_of"))
    placed = placed.join(of, "_bucket").withColumn("_i", F.col("_rank") - F.col("_begin") + 1)
    share = F.floor(F.col("_i") * percentiles / F.col("_of"))
    marks = F.when(share > F.floor((F.col("_i") - 1) * percentiles / F.col("_of")), F.struct("v", (share / percentiles).alias("share")))
    out = placed.groupBy("_bucket").agg(
        F.sum("n").cast("double").alias("frequency"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n_distinct"), F.sort_array(F.collect_list(marks)).alias("percentiles")
    )
    return out.drop("_bucket")


class _Bucket(NamedTuple):
    """A run of values by rank, the value that cut it off above, and what the next cut in it would be."""

    first: int
    last: int
    above: float | None
    gain: float | None = None
    at: int = 0


def maxdiff_area_histogram(df: DataFrame, field: str, buckets: int = 20) -> DataFrame:
    """MaxDiff(V, A) buckets of a field of numbers: frequency, low, high and distinct.

    A value's area is its frequency times its spread, the distance to the next value. The bucket in which neighbours'
    areas differ most, as shares of its rows and its range, is cut there, until there are as many as wanted: at the value
    itself where the frequencies make the difference or its lower neighbour is the farther one, else above it. The last
    value's spread is that before it, up to the cut above. All rows are counted, by value. A step sums up the two new
    buckets in one pass over the values, so there are as many steps as buckets, however many values.
    """
    fields_exist(df, field)
    if kind(df.schema[field].dataType) != "number":
        raise BadSemantic(f"{field} has no spreads")
    v, n, last, next_ = (F.col(c).cast("double") for c in ("v", "n", "_last", "_next"))
    spread, back = next_ - v, v - last
    gain = F.abs(n * spread - F.col("_last_n") * back)
    values = stored(_valued(df, field).withColumns({"_gain": gain, "_spread": spread, "_back": back}), "areas")

    def measured(parts: list[_Bucket]) -> list[_Bucket]:
        """The buckets with their best cuts, by one aggregation."""
        r = F.col("_rank")
        part = reduce(lambda x, p: F.when((r >= p[1].first) & (r <= p[1].last), p[0]).otherwise(x), enumerate(parts), F.lit(None))
        ends = reduce(lambda x, p: F.when(F.col("_p") == p[0], (r > p[1].first) & (r < p[1].last)).otherwise(x), enumerate(parts), F.lit(False))
        best = F.max_by(F.struct("_rank", "_gain", "_spread", "_back", "n", "_last_n"), F.when(ends, F.struct("_gain", -r)))
        end = F.max_by(F.struct("_rank", "v", "n", "_last_n", "_back"), r)
        rows = values.withColumn("_p", part).where("_p IS NOT NULL").groupBy("_p").agg(F.sum("n").alias("total"), F.min("v").alias("low"), best.alias("best"), end.alias("end")).collect()
        out = []
        for row in sorted(rows, key=lambda r: r["_p"]):
            b, end = parts[row["_p"]], row["end"]
            if b.first == b.last:
                out.append(b)
                continue
            total, width = float(row["total"]), float(end["v"]) - float(row["low"])
            ahead = float(end["_back"]) if b.above is None else min(float(end["_back"]), b.above - float(end["v"]))
            choices = [(abs(end["n"] * ahead - end["_last_n"] * end["_back"]) / (total * width), b.last)]
            if row["best"] is not None:
                x = row["best"]
                by_frequency = abs(x["n"] - x["_last_n"]) / total > abs(x["_spread"] - x["_back"]) / width
                choices.insert(0, (x["_gain"] / (total * width), x["_rank"] + (0 if by_frequency or x["_back"] > x["_spread"] else 1)))
            gain, at = max(choices, key=lambda c: c[0])
            out.append(b._replace(gain=gain, at=at))
        return out

    whole = values.agg(F.max("_rank")).first()[0]
    made = measured([_Bucket(1, whole, None)]) if whole else []
    while 0 < len(made) < buckets and any(b.gain is not None for b in made):
        cut = max((b for b in made if b.gain is not None), key=lambda b: b.gain)
        value = float(values.where(F.col("_rank") == cut.at).first()["v"])
        upper, lower = measured([_Bucket(cut.at, cut.last, cut.above), _Bucket(cut.first, cut.at - 1, value)])
        made[made.index(cut)] = upper  # of equal gains, the bucket that was there first is cut
        made.append(lower)
    number = reduce(add, [(F.col("_rank") >= b.first).cast("int") for b in made], F.lit(0))
    out = values.groupBy(number.alias("_bucket")).agg(F.sum("n").cast("double").alias("frequency"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n_distinct"))
    return out.drop("_bucket")


def estimated_range(histogram: DataFrame, low: float, high: float) -> DataFrame:
    """One row, n_rows: how many rows a histogram expects between low and high, both included, with a bucket's rows spread evenly over its range."""
    a, b = F.greatest(F.col("low").cast("double"), F.lit(float(low))), F.least(F.col("high").cast("double"), F.lit(float(high)))
    width = F.col("high").cast("double") - F.col("low").cast("double")
    share = F.when(a > b, 0.0).when(width == 0, 1.0).otherwise((b - a) / F.when(width != 0, width))
    return histogram.agg(F.coalesce(F.sum(F.col("frequency") * share), F.lit(0.0)).alias("n_rows"))
