"""Business figures over the enriched tables. Null keys form no group; every top-n breaks ties by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import percent, share, total
from ..functions.values import WEEKDAYS
from .stats import distributions

DELIVERED = "delivered"
FAILED = ("canceled", "unavailable")


def counts(df: DataFrame, key: str, name: str = "order_count") -> DataFrame:
    """key, count; largest first, as both status and payment-method distributions are shown."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def histogram(df: DataFrame, key: str, name: str = "order_count") -> DataFrame:
    """key, count; by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).orderBy(key)


def star_label(score: Column) -> Column:
    return F.format_string("%.0f Stars", score.cast("double"))


def review_scores(orders: DataFrame) -> DataFrame:
    return histogram(orders, "review_score").withColumn("stars", star_label(F.col("review_score")))


def monthly_orders(orders: DataFrame) -> DataFrame:
    return orders.where("order_year_month is not null").groupBy("order_year_month").agg(F.count_distinct("order_id").alias("order_count")).orderBy("order_year_month")


def monthly_revenue(orders: DataFrame, delivered: str = DELIVERED) -> DataFrame:
    kept = orders.where((F.col("order_status") == delivered) & F.col("order_year_month").isNotNull())
    return kept.groupBy("order_year_month").agg(total(F.col("total_payment_value")).alias("revenue")).orderBy("order_year_month")


def _top(df: DataFrame, key: str, value: Column, name: str, n: int) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias(name)).orderBy(F.desc_nulls_last(name), key).limit(n)


def top_cities(orders: DataFrame, n: int = 10) -> DataFrame:
    return _top(orders, "customer_city", F.count_distinct("order_id"), "order_count", n)


def top_categories(items: DataFrame, n: int = 10) -> DataFrame:
    return _top(items, "product_category_name_english", total(F.col("price")), "revenue", n)


def top_failed_categories(items: DataFrame, orders: DataFrame, n: int = 10, failed: tuple[str, ...] = FAILED) -> DataFrame:
    bad = orders.where(F.col("order_status").isin(*failed)).select("order_id")
    return _top(items.join(bad, "order_id", "left_semi"), "product_category_name_english", F.count_distinct("order_id"), "failed_orders", n)


def peak_hours(orders: DataFrame) -> DataFrame:
    """A row a weekday, Monday first, a column an hour (h0 .. h23): distinct orders, null where there are none."""
    days = orders.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "day_number int, order_day string")
    cells = orders.where("order_day is not null and order_hour is not null").groupBy("order_day", "order_hour").agg(F.count_distinct("order_id").alias("n"))
    hours = [F.nullif(F.max(F.when(F.col("order_hour") == h, F.col("n"))), F.lit(0)).alias(f"h{h}") for h in range(24)]
    grid = cells.groupBy("order_day").agg(*hours)
    return F.broadcast(days).join(grid, "order_day", "left").orderBy("day_number")


def delivery_summary(orders: DataFrame) -> DataFrame:
    """Late share of all orders; days over the delivered ones."""
    return orders.agg(share(F.col("is_late_delivery")).alias("late_delivery_rate"), F.count("delivery_days").alias("n_delivered"), F.avg("delivery_days").alias("avg_delivery_days"))


def late_by_state(orders: DataFrame, n: int = 15) -> DataFrame:
    """Late percentage among delivered orders by state."""
    late = F.col("is_late_delivery")
    shown = orders.where("delivery_delay_days is not null and customer_state_name is not null").groupBy("customer_state_name").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("on_time"))
    return shown.withColumn("late_pct", percent(F.col("late"), F.col("late") + F.col("on_time"))).orderBy(F.desc("late_pct"), "customer_state_name").limit(n)


def late_sellers(sellers: DataFrame, n: int = 10) -> DataFrame:
    return sellers.orderBy(F.desc_nulls_last("late_delivery_rate"), "seller_id").limit(n)


def scores_by_delay(reviews: DataFrame, score: str = "review_score") -> DataFrame:
    kept = reviews.where(F.col("delay_bucket").isNotNull() & F.col(score).isNotNull())
    return kept.groupBy("delay_bucket").agg(F.avg(score).alias("mean_score"), F.median(score).alias("median_score"), F.stddev_samp(score).alias("std_score"), F.count(score).alias("n"))


def described(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Long form of grouped count, mean, std, min, quartiles and max, a row a group and column; null keys form no group."""
    return distributions(df, columns, [0.25, 0.5, 0.75], [by]).select(by, "column", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def repeat_rate(customers: DataFrame) -> DataFrame:
    repeat = share(F.col("is_repeat_customer")) * 100
    return customers.agg(repeat.alias("repeat_customer_pct"), (100 - repeat).alias("one_time_customer_pct"), F.count("*").alias("n_customers"))


def order_facts(orders: DataFrame, items: DataFrame) -> DataFrame:
    """What business_summary() needs of every order, and of items whose order is unknown: its sums and its sellers."""
    lines = items.groupBy("order_id").agg(total(F.col("price")).alias("item_revenue"), F.collect_set("seller_id").alias("sellers"))
    known = orders.select(F.col("order_id").alias("known_order"), "customer_unique_id", "order_status", "total_payment_value", "review_score", "is_late_delivery")
    return known.join(lines, F.col("known_order") == F.col("order_id"), "full").drop("order_id")


def business_summary(facts: DataFrame, delivered: str = DELIVERED) -> DataFrame:
    """One row of headline figures from order_facts(); statuses as sorted (status, count) pairs.

    Every order speaks for its status, its customer and its sellers: one grouping by all of these counts them all, and
    its rows, one a customer, seller or status, give the figures."""
    order = F.col("known_order").isNotNull()
    fact = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    speaks = F.concat(F.array(fact("lines", F.lit(None))), F.when(order, F.array(fact("status", F.col("order_status")), fact("customer", F.col("customer_unique_id")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")), F.transform(F.coalesce("sellers", F.array()), lambda s: fact("seller", s)))
    score, late = F.nullif(F.col("review_score"), F.lit(0.0)), F.col("is_late_delivery")
    paid = F.when(F.col("order_status") == delivered, F.col("total_payment_value"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    spread = facts.select(F.explode(speaks).alias("f"), paid.alias("paid"), score.alias("score"), late.cast("int").alias("late"), "item_revenue").select("f.*", "paid", "score", "late", "item_revenue")
    groups = spread.groupBy("kind", "key").agg(F.count("*").alias("n"), *[F.sum(of("status", F.col(c))).alias(c) for c in ("paid", "score", "late")], F.count(of("status", F.col("score"))).alias("scores"), F.count(of("status", F.col("late"))).alias("lates"), F.sum(of("lines", F.col("item_revenue"))).alias("items"))
    known, n = F.col("key").isNotNull(), F.col("n")
    people = F.count_if((F.col("kind") == "customer") & known)
    status = F.collect_list(F.when((F.col("kind") == "status") & known, F.struct(F.col("key").alias("order_status"), n.alias("count"))))
    return groups.agg(
        F.coalesce(F.sum(of("status", n)), F.lit(0)).alias("total_unique_orders"),
        F.coalesce(F.sum("paid"), F.lit(0.0)).alias("total_order_payment_revenue_delivered"),
        F.try_divide(F.sum("score"), F.sum("scores")).alias("avg_review_score"),
        (F.try_divide(F.sum("late"), F.sum("lates")) * 100).alias("late_delivery_rate_pct"),
        F.coalesce(F.sum("items"), F.lit(0.0)).alias("total_item_revenue"),
        people.alias("total_unique_customers"),
        (F.try_divide(F.count_if((F.col("kind") == "customer") & known & (n > 1)), people) * 100).alias("repeat_customer_rate_pct"),
        F.count_if((F.col("kind") == "seller") & known).alias("total_unique_sellers"),
        F.array_sort(status).alias("order_status_distribution"),
    )


def customer_summary(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count_distinct("customer_unique_id").alias("total_customers"),
        F.bround(share(F.col("is_repeat_customer")) * 100, 2).alias("repeat_customer_pct"),
        F.bround(F.avg("order_count"), 3).alias("avg_orders_per_customer"),
        F.bround(F.avg("total_spend"), 2).alias("avg_spend_per_customer"),
    )


def seller_summary(sellers: DataFrame) -> DataFrame:
    return sellers.agg(
        F.count_distinct("seller_id").alias("total_sellers"),
        F.bround(F.avg("late_delivery_rate") * 100, 2).alias("avg_late_delivery_rate_pct"),
        F.bround(F.avg("item_revenue"), 2).alias("avg_item_revenue"),
    )
