"""Quantiles, histograms, densities, box summaries and hexagonal bins.

Everything but the hexagons starts from `value_counts`: one scan and one map-side combined
aggregate reduce a table to (metric, value, n). The metrics are whole counts, so d distinct
values add up to at least d^2/2; the counted table therefore has at most about
sqrt(2 * total) rows per metric, and ordering it per metric stays cheap at any table size.
Metrics of real numbers go through `value_summary` first, which bounds their distinct values.
(Times of last change come in whole days; they are only binned, never ordered.)
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from encore.operators.scope import hash_sample


def value_counts(table: DataFrame, metrics: list[str] | dict[str, Column]) -> DataFrame:
    """(metric, value, n) over the non-missing values of several columns."""
    columns = metrics if isinstance(metrics, dict) else {m: F.col(m) for m in metrics}
    cells = [F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in columns.items()]
    return (
        table.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
        .groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n")))


def value_summary(table: DataFrame, metrics: list[str] | dict[str, Column], digits: int = 4) -> DataFrame:
    """(metric, side, place, cell, lo, hi, n): counts of values that agree in `digits` significant digits.

    For metrics of real numbers, whose distinct values may be as many as the rows. A cell's values differ by less than
    10^(1 - digits) of their size, so the rows stay at 18 * 10^(digits - 1) for each power of ten that occurs. Summaries
    of parts are merged by `merged_summaries`. Infinite values and NaN are left out.
    """
    values = value_counts(table, metrics)
    size, side = F.abs("value"), F.signum("value")
    near = F.floor(F.log10(size)).cast("int")

    def power(n):
        return F.pow(F.lit(10.0), n)

    # the logarithm may be off by one next to a power of ten
    place = F.when(size == 0, F.lit(0)).when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near)
    cell = F.floor(F.try_divide(size, power(F.col("place") - digits + 1)))
    return merged_summaries(
        values.filter((size < float("inf")) & ~F.isnan("value")).withColumn("place", place)
        .withColumns({"side": side.cast("int"), "cell": F.coalesce(cell, F.lit(0).cast("bigint"))})
        .withColumns({"lo": F.col("value"), "hi": F.col("value")}))


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """One summary of the rows of several, put together by `union`."""
    return summaries.groupBy("metric", "side", "place", "cell").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def summary_counts(summary: DataFrame) -> DataFrame:
    """(metric, value, n) as from `value_counts`: a cell's only value itself, or else the middle of its range.

    Each value stands for others that differ from it by less than half of 10^(1 - digits) of their size, and so do the
    quantiles that are taken from it.
    """
    middle = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return summary.select("metric", middle.alias("value"), "n")


def _running(counts: DataFrame) -> DataFrame:
    upto = W.partitionBy("metric").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("metric")
    return counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})


def quantiles(counts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per metric, linear between the two neighbouring order statistics."""
    return _running(counts).groupBy("metric").agg(*[_quantile(p).alias(n) for n, p in probabilities.items()])


def _quantile(p: float, over=lambda part: part) -> Column:
    """The quantile as an aggregate over running counts, or over a window."""
    place = F.lit(p) * (F.col("total") - 1)
    low = over(F.min(F.when(F.col("upto") > F.floor(place), F.col("value"))))
    high = over(F.min(F.when(F.col("upto") > F.ceil(place), F.col("value"))))
    return low + (high - low) * over(F.max(place - F.floor(place)))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _limits(counts: DataFrame) -> DataFrame:
    return counts.groupBy("metric").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total"))


def histogram(counts: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins over each metric's range, all bins listed, the last one closed.

    A constant metric gets one unit-wide range centred on its value.
    """
    flat = F.col("lo") == F.col("hi")
    limits = _limits(counts).select(
        "metric", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    index = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("bigint")
    filled = (counts.join(limits, "metric").select("metric", index.alias("bin"), "n")
              .groupBy("metric", "bin").agg(F.sum("n").alias("n")))
    every = limits.select("metric", "lo", width.alias("w"),
                          F.explode(_numbers(bins)).alias("bin"))
    return every.join(filled, ["metric", "bin"], "left").select(
        "metric", "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_hi"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def visible_bins(hist: DataFrame, lo: float, hi: float) -> DataFrame:
    """Bins that reach into the shown range [lo, hi]."""
    return hist.filter((F.col("bin_hi") >= lo) & (F.col("bin_lo") <= hi))


def density(counts: DataFrame, points: int = 200, cut: float = 0.0) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth s * n^(-1/5).

    Each distinct value meets the fixed number of grid points once, weighted by its count.
    """
    stats = counts.groupBy("metric").agg(
        F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    spread = (
        counts.join(stats.select("metric", "mean"), "metric").groupBy("metric")
        .agg(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2).alias("ss")))
    bandwidth = F.sqrt(F.try_divide(F.col("ss"), F.col("total") - 1)) * F.pow(F.col("total"), F.lit(-0.2))
    setup = stats.join(spread, "metric").select("metric", "total", "lo", "hi", bandwidth.alias("h")).filter("h > 0")
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / F.lit(float(points - 1))
    start = F.col("lo") - cut * F.col("h")
    bump = F.exp(-0.5 * ((F.col("x") - F.col("value")) / F.col("h")) ** 2)
    return (
        counts.join(setup, "metric")
        .select("metric", "value", "n", "h", "total", start.alias("start"), step.alias("step"),
                F.explode(_numbers(points)).alias("point"))
        .withColumn("x", F.col("start") + F.col("point") * F.col("step"))
        .groupBy("metric", "point")
        .agg(F.max("x").alias("x"),
             (F.sum(F.col("n") * bump) / (F.max("total") * F.max("h") * math.sqrt(2 * math.pi))).alias("density")))


def box_summary(counts: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 interquartile ranges, number of outliers.

    The counts are read once: the quartiles travel beside them.
    """
    whole = W.partitionBy("metric")
    box = _running(counts).withColumns({
        n: _quantile(p, lambda part: part.over(whole)) for n, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items()})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        box.groupBy("metric", "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
             F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
             F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers")))


def scatter_sample(info: DataFrame, fraction: float = 0.1) -> DataFrame:
    """The points of the scatter plots: a repeatable sample of the given playlists."""
    return hash_sample(info, "pid", fraction).select("pid", "num_tracks", "num_followers", "modified_at")


def hexbin(points: DataFrame, x: str, y: str, gridsize: int = 50, rows: int | None = None) -> DataFrame:
    """Counts per hexagon. Hexagon centres form two shifted lattices; a point joins the nearer centre."""
    rows = rows or int(gridsize / math.sqrt(3))
    limits = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    lim = limits.select(F.struct("*")).scalar()

    def unit(lo, hi, cells):
        return F.coalesce(F.nullif((lim[hi] - lim[lo]).cast("double"), F.lit(0.0)), F.lit(1.0)) / F.lit(float(cells))

    sx, sy = unit("x0", "x1", gridsize), unit("y0", "y1", rows)
    placed = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        lim["x0"].cast("double").alias("x0"), lim["y0"].cast("double").alias("y0"), sx.alias("sx"), sy.alias("sy"),
        ((F.col(x) - lim["x0"]) / sx).alias("u"), ((F.col(y) - lim["y0"]) / sy).alias("v"))

    def distance(cu, cv):
        return (F.col("u") - cu) ** 2 + 3.0 * (F.col("v") - cv) ** 2

    corner_u, corner_v = F.floor(F.col("u") + 0.5), F.floor(F.col("v") + 0.5)
    inner_u, inner_v = F.floor("u") + 0.5, F.floor("v") + 0.5
    corner = distance(corner_u, corner_v) < distance(inner_u, inner_v)
    return (
        placed.select(
            "x0", "y0", "sx", "sy",
            F.when(corner, corner_u.cast("double")).otherwise(inner_u).alias("cu"),
            F.when(corner, corner_v.cast("double")).otherwise(inner_v).alias("cv"))
        .groupBy("cu", "cv", "x0", "y0", "sx", "sy").agg(F.count(F.lit(1)).alias("n"))
        .select((F.col("x0") + F.col("cu") * F.col("sx")).alias("x_center"),
                (F.col("y0") + F.col("cv") * F.col("sy")).alias("y_center"), "n"))
