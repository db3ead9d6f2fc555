"""Rank statistics and tests. Ranks come from value counts, so no task holds more than the distinct values of a share."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.tails import mann_whitney_two_sided, student_two_sided


#: Edges, of which there are fewer than twice the first step, are looked up by halving steps.
STEPS = tuple(1 << n for n in reversed(range(10)))


def _below(edges: Column, value: Column) -> Column:
    """How many of the sorted edges are smaller than value."""
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at))


def with_bins(cells: DataFrame, value: str, counts: list[str], of: list[str] | None = None) -> DataFrame:
    """cells (a row a distinct value, with counts) with `_bin`: about equally many of them in each, by edges found in the
    same plan. `of`: columns of few values that have edges of their own.

    There are as many bins as shuffle partitions, 64 at least. The totals make both readings of the cells ask for the
    same columns, so that Spark computes them once."""
    of = of or []
    wanted = min(1000, max(64, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = F.array(*[F.lit(n / wanted) for n in range(1, wanted)])
    found = cells.groupBy(*of).agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, 4 * wanted))).alias("_edges"), *[F.sum(c).alias(f"_all_{n}") for n, c in enumerate(counts)])
    some = reduce(lambda a, b: a | b, (F.col(f"_all_{n}") >= 0 for n in range(len(counts))))
    met = cells.join(F.broadcast(found), of) if of else cells.join(F.broadcast(found), F.lit(True))
    return met.withColumn("_bin", F.coalesce(F.when(some, _below(F.col("_edges"), F.col(value).cast("double"))), F.lit(0))).drop("_edges", *[f"_all_{n}" for n in range(len(counts))])


def offsets(cells: DataFrame, weights: dict[str, str], order: Column, bin_order: Column, by: list[str]) -> DataFrame:
    """cells (one row a value, with its `_bin`) with, for each weight, the sum over the values before (named by the dict).

    Running sums stay inside a bin; the bins' own totals, a few rows a group, give where each starts.
    """
    inside = W.partitionBy(*by, "_bin").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    run = cells.withColumns({f"_in_{n}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w, n in weights.items()})
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(bin_order).rowsBetween(W.unboundedPreceding, -1)
    totals = cells.groupBy(*by, "_bin").agg(*[F.sum(w).alias(w) for w in weights])
    starts = totals.select(*by, "_bin", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_from_{n}") for w, n in weights.items()])
    joined = run.join(F.broadcast(starts), [*by, "_bin"])
    return joined.withColumns({n: F.col(f"_in_{n}") + F.col(f"_from_{n}") for n in weights.values()}).drop("_bin", *[f"{x}_{n}" for n in weights.values() for x in ("_in", "_from")])


def average_ranks(df: DataFrame, value: str, rank: str, by: list[str] | None = None) -> DataFrame:
    """by, value, its average rank among the group's non-null rows and its count; equal values, however many, are one row."""
    by = by or []
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = offsets(with_bins(cells, value, ["_n"]), {"_n": "_before"}, F.col(value), F.col("_bin"), by)
    return placed.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(rank), F.col("_n").alias(f"{rank}_ties"))


def value_cells(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, column, _v, _n: how often each group has each value of each column, nulls apart; one reading for all columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_x")
    return df.select(*by, each).select(*by, "_x.column", "_x._v").where("_v is not null").groupBy(*by, "column", "_v").agg(F.count("*").alias("_n"))


def at_place(before: Column, n: Column, value: Column, place: Column) -> Column:
    """The value at a place (from 0, not above the last) of the sorted rows; between two, on the line that joins them."""
    at = lambda p: F.max(F.when((before <= p) & (p < before + n), value))
    low, high = at(F.floor(place)), at(F.ceil(place))
    return low + (high - low) * (F.first(place) - F.floor(F.first(place)))


def distributions(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, column, n, mean, std, min, max, q: of the group's non-null values of each column, with exact quantiles on
    straight lines between neighbours. Null keys form no group; one without a value has no row for that column.

    The frame is read once, whatever the number of columns, groups and shares: everything comes from counts of values."""
    by = by or []
    keys = [*by, "column"]
    cells = value_cells(reduce(lambda d, c: d.where(F.col(c).isNotNull()), by, df), columns, by)
    n, v = F.col("_n"), F.col("_v")
    whole = cells.groupBy(*keys).agg(F.sum("_n").alias("_all"), (F.sum(n * v) / F.sum("_n")).alias("_mean"))  # a few rows a group
    placed = offsets(with_bins(cells, "_v", ["_n"], ["column"]), {"_n": "_before"}, v, F.col("_bin"), keys)
    met = placed.join(F.broadcast(whole), keys)
    all_, mean = F.first("_all"), F.first("_mean")
    places = [(F.col("_all") - 1) * F.lit(float(s)) for s in shares]
    spread = F.when(all_ > 1, F.sqrt(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))) / (all_ - 1)))
    return met.groupBy(*keys).agg(all_.alias("n"), mean.alias("mean"), spread.alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.array(*[at_place(F.col("_before"), n, v, p) for p in places]).alias("q"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q: the exact quantiles of the group's non-null values, straight lines between neighbours. Null keys form no
    group, nor do groups without a value."""
    by = by or []
    return distributions(df, [value], shares, by).select(*by, "q")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, spearman for every pair of columns (both orders and itself), over the rows where both are known.

    A value has one rank for each column that it may be paired with: its place among the rows where that one is known
    too. All of them come from one count by column and value, of as many sums as there are columns, and go back to the
    rows at once; so a row is copied once a column, not once a pair."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    place = {c: n for n, c in enumerate(columns)}
    both = [f"_n{n}" for n in range(len(columns))]
    unpivoted = lambda more: F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("c"), F.col(c).alias("v"), *more) for c, n in place.items()]), lambda s: s["v"].isNotNull())).alias("s")
    known = [F.col(c).isNotNull().alias(f"k{n}") for c, n in place.items()]
    cells = wide.select(unpivoted(known)).groupBy(F.col("s.c").alias("c"), F.col("s.v").alias("v")).agg(*[F.count_if(f"s.k{n}").alias(both[n]) for n in place.values()])
    placed = offsets(with_bins(cells, "v", both, ["c"]), {x: f"_before{x}" for x in both}, F.col("v"), F.col("_bin"), ["c"])
    ranks = placed.select("c", "v", F.array(*[F.col(f"_before{x}") + (F.col(x) + 1) / 2 for x in both]).alias("r"))
    rows = wide.withColumn("row", F.monotonically_increasing_id()).select("row", unpivoted([])).select("row", "s.c", "s.v")
    own = lambda n: F.max(F.when(F.col("c") == n, F.col("r"))).alias(f"r{n}")
    ranked = rows.join(ranks, ["c", "v"]).groupBy("row").agg(*[own(n) for n in place.values()])
    pairs = list(itertools.combinations_with_replacement(place.values(), 2))

    def sums(a: int, b: int) -> Column:
        x, y = (F.get(f"r{i}", F.lit(j)) for i, j in ((a, b), (b, a)))
        met = x.isNotNull() & y.isNotNull()
        x, y = F.when(met, x), F.when(met, y)
        return F.struct(F.lit(columns[a]).alias("x"), F.lit(columns[b]).alias("y"), F.count(x).alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])

    found = ranked.agg(F.array(*[sums(a, b) for a, b in pairs]).alias("all")).select(F.explode("all").alias("p")).select("p.*").where("n > 0")
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    value = found.select("x", "y", F.try_divide(n * sxy - sx * sy, F.nullif(spread, F.lit(0.0))).alias("spearman"))
    turned = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return value.select(F.explode(turned).alias("p"), "spearman").select("p.x", "p.y", "spearman")


def order_correlations(orders: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman matrix at order grain; an order's price and freight are the means of its items."""
    means = items.where("order_id is not null").groupBy("order_id").agg(F.avg("price").alias("price"), F.avg("freight_value").alias("freight_value"))
    return spearman(orders.join(means, "order_id"), columns)


def two_groups(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row: n, mean, median, std of the flagged and the other rows, Welch's t, U of the flagged, its tie sum, d.

    Everything comes from one count by value of the rows on either side."""
    sides = ("late", "on_time")
    known = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(flag).alias("f"))
    cells = known.groupBy("v").agg(F.count_if("f").alias("late"), F.count_if(~F.col("f")).alias("on_time"))
    v = F.col("v")
    whole = cells.agg(*[x for s in sides for x in (F.coalesce(F.sum(s), F.lit(0)).alias(f"n_{s}"), F.try_divide(F.sum(F.col(s) * v), F.sum(s)).alias(f"mean_{s}"))])
    placed = offsets(with_bins(cells, "v", [*sides]), {s: f"before_{s}" for s in sides}, v, F.col("_bin"), [])
    met = whole.join(placed, F.lit(True), "left")
    n, both = {s: F.first(f"n_{s}") for s in sides}, F.col("late") + F.col("on_time")
    rank = F.col("before_late") + F.col("before_on_time") + (both + 1) / 2
    of = lambda s: [n[s].alias(f"n_{s}"), F.first(f"mean_{s}").alias(f"mean_{s}"), at_place(F.col(f"before_{s}"), F.col(s), v, (F.col(f"n_{s}") - 1) * 0.5).alias(f"median_{s}"), F.when(n[s] > 1, F.sum(F.col(s) * (v - F.col(f"mean_{s}")) * (v - F.col(f"mean_{s}"))) / (n[s] - 1)).alias(f"var_{s}")]
    sums = met.agg(*of("late"), *of("on_time"), F.sum(F.col("late") * rank).alias("rank_sum"), F.sum(F.pow(both.cast("double"), 3) - both).alias("tie_sum"))
    n1, n2, v1, v2 = (F.col(c) for c in ("n_late", "n_on_time", "var_late", "var_on_time"))
    return sums.select(
        *[c for s in sides for c in (f"n_{s}", f"mean_{s}", f"median_{s}", F.sqrt(f"var_{s}").alias(f"std_{s}"))],
        F.try_divide(F.col("mean_late") - F.col("mean_on_time"), F.sqrt(v1 / F.nullif(n1, F.lit(0)) + v2 / F.nullif(n2, F.lit(0)))).alias("welch_t"),
        (F.col("rank_sum") - n1 * (n1 + 1) / 2).alias("mann_whitney_u"),
        "tie_sum",
        F.try_divide(F.col("mean_on_time") - F.col("mean_late"), F.sqrt((v1 + v2) / 2)).alias("cohens_d"),
    )


def late_significance(orders: DataFrame, alpha: float = 0.05) -> dict:
    """The test report of review scores of late against other deliveries; significance goes by U's p-value."""
    kept = orders.where("delivery_delay_days is not null and review_score is not null")
    r = two_groups(kept, "review_score", "is_late_delivery").first().asDict()
    n1, n2, s1, s2 = r["n_late"], r["n_on_time"], r["std_late"], r["std_on_time"]
    t_p = u_p = None
    if r["welch_t"] is not None:
        a, b = s1 * s1 / n1, s2 * s2 / n2
        t_p = student_two_sided(r["welch_t"], (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)))
    if n1 and n2:
        u_p = mann_whitney_two_sided(r["mann_whitney_u"], n1, n2, r["tie_sum"] or 0.0)
    side = lambda s: {k: r[f"{k}_{s}"] for k in ("n", "mean", "median", "std")}
    return {
        "late_delivery": side("late"),
        "on_time_delivery": side("on_time"),
        "welch_t_test": {"statistic": r["welch_t"], "p_value": t_p},
        "mann_whitney_u_test": {"statistic": r["mann_whitney_u"], "p_value": u_p},
        "effect_size_cohens_d": r["cohens_d"],
        "alpha": alpha,
        "statistically_significant": u_p is not None and u_p < alpha,
    }


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as z-scores by mean and population deviation; a constant column becomes 0."""
    sums = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])

    def z(c: str) -> Column:
        return (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))

    return df.join(F.broadcast(sums)).select(*[F.col(c) for c in df.columns if c not in columns], *[z(c).alias(c) for c in columns])
