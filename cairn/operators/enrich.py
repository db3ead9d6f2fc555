"""Grain-correct enriched tables: each N-side is summed to its key before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import cuts, share, total, weekday, whole_days, year_month
from ..functions.values import region
from .cleaning import first_of
from .stats import quantiles

DELAY_EDGES = (-100, 0, 5, 15, 100)
DELAY_LABELS = ("Early/On-time", "0-5 days late", "5-15 days late", "15+ days late")


class GrainError(ValueError):
    """A table holds a key more than once where its grain is one row a key."""


def payment_summary(payments: DataFrame) -> DataFrame:
    """order_id, total_payment_value, main_payment_type, payment_installments in two partial aggregations.

    The main type is the most frequent one, the smallest of equals.
    """
    by_type = payments.where("order_id is not null").groupBy("order_id", "payment_type").agg(F.sum("payment_value").alias("v"), F.count("*").alias("n"), F.max("payment_installments").alias("i"))
    most = F.min_by("payment_type", F.when(F.col("payment_type").isNotNull(), F.struct(-F.col("n"), F.col("payment_type"))))
    return by_type.groupBy("order_id").agg(total(F.col("v")).alias("total_payment_value"), most.alias("main_payment_type"), F.max("i").alias("payment_installments"))


def payment_totals(payments: DataFrame) -> DataFrame:
    return payments.where("order_id is not null").groupBy("order_id").agg(total(F.col("payment_value")).alias("total_payment_value"))


def review_summary(reviews: DataFrame) -> DataFrame:
    return reviews.where("order_id is not null").groupBy("order_id").agg(F.avg("review_score").alias("review_score"))


def with_order_features(orders: DataFrame) -> DataFrame:
    """Delivery days and delay (null if undelivered), lateness (false if undelivered), hour, weekday, month."""
    bought, came, due = (F.col(c) for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"))
    delay = whole_days(due, came)
    return orders.withColumns(
        {
            "delivery_days": whole_days(bought, came),
            "delivery_delay_days": delay,
            "is_late_delivery": F.coalesce(delay > 0, F.lit(False)),
            "order_hour": F.hour(bought),
            "order_day": weekday(bought),
            "order_year_month": year_month(bought),
        }
    )


def orders_enriched(orders: DataFrame, customers: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row an order: customer, payment and review figures, delivery and calendar features, region."""
    joined = orders.join(customers, "customer_id", "left").join(payment_summary(payments), "order_id", "left").join(review_summary(reviews), "order_id", "left")
    filled = joined.na.fill({"total_payment_value": 0.0, "main_payment_type": "not_defined", "payment_installments": 1})
    known = F.col("region") if "region" in filled.columns else region(F.col("customer_state"))
    return with_order_features(filled).withColumns({"customer_state_name": F.col("customer_state").cast("string"), "region": known})


def translated(products: DataFrame, translation: DataFrame) -> DataFrame:
    return products.join(translation, "product_category_name", "left")


def price_fences(items: DataFrame, price: str = "price") -> DataFrame:
    """One row: the exact quartiles' fences, 1.5 interquartile ranges out."""
    quartiles = quantiles(items, price, [0.25, 0.75])
    low, high = F.col("q")[0], F.col("q")[1]
    return quartiles.select((low - 1.5 * (high - low)).alias("low_fence"), (high + 1.5 * (high - low)).alias("high_fence"))


def with_price_outliers(items: DataFrame, price: str = "price", priced: DataFrame | None = None) -> DataFrame:
    """Flags rows strictly beyond the fences; a null price is no outlier. The fences are one broadcast row (none where
    no price is known). `priced`: the rows that the fences are of, if those before the joins serve as well."""
    flag = F.coalesce((F.col(price) < F.col("low_fence")) | (F.col(price) > F.col("high_fence")), F.lit(False))
    fences = price_fences(items if priced is None else priced, price)
    return items.join(F.broadcast(fences), F.lit(True), "left").withColumn("is_price_outlier", flag).drop("low_fence", "high_fence")


def items_categorised(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """One row an item with its product. Products' categories are filled before the join, so items without a product keep
    nulls. Figures by category need no more than this: neither sellers nor fences."""
    named = translated(products, translation).na.fill({"product_category_name_english": "Unknown", "product_category_name": "Unknown"})
    return items.join(named, "product_id", "left")


def order_items_enriched(items: DataFrame, products: DataFrame, sellers: DataFrame, translation: DataFrame) -> DataFrame:
    """One row an item with its product, its seller and whether its price lies beyond the fences."""
    joined = items_categorised(items, products, translation).join(sellers, "seller_id", "left")
    return with_price_outliers(joined, priced=items).withColumn("seller_state_name", F.col("seller_state").cast("string"))


def with_delay_bucket(df: DataFrame, delay: str = "delivery_delay_days") -> DataFrame:
    return df.withColumn("delay_bucket", cuts(F.col(delay), DELAY_EDGES, DELAY_LABELS))


def reviews_enriched(reviews: DataFrame, orders: DataFrame | None = None, order: tuple[str, ...] = ("order_id",)) -> DataFrame:
    """One row a review id (the first by `order`), with its order's delay, lateness, state, region and delay bucket."""
    one = first_of(reviews, ["review_id"], [F.col(c).asc_nulls_last() for c in order])
    if orders is None:
        return one
    return with_delay_bucket(one.join(orders.select("order_id", "delivery_delay_days", "is_late_delivery", "customer_state_name", "region"), "order_id", "left"))


def customers_enriched(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row a person: orders, spend, first and last order, mean score, repeat flag, city and state."""
    sums = orders.where("customer_unique_id is not null").groupBy("customer_unique_id").agg(
        F.count_distinct("order_id").alias("order_count"),
        total(F.col("total_payment_value")).alias("total_spend"),
        F.min("order_purchase_timestamp").alias("first_order_at"),
        F.max("order_purchase_timestamp").alias("last_order_at"),
        F.avg("review_score").alias("avg_review_score"),
    )
    place = F.struct("customer_id", "customer_city", "customer_state")
    identity = customers.groupBy("customer_unique_id").agg(F.min(place).alias("p")).select("customer_unique_id", "p.customer_city", "p.customer_state")
    return sums.withColumn("is_repeat_customer", F.col("order_count") > 1).join(identity, "customer_unique_id", "left")


def seller_lateness(items: DataFrame, orders: DataFrame) -> DataFrame:
    """seller_id, order_count, late rate over a seller's distinct orders."""
    pairs = items.where("seller_id is not null").select("order_id", "seller_id").distinct()
    met = pairs.join(orders.select("order_id", "is_late_delivery"), "order_id", "left")
    return met.groupBy("seller_id").agg(F.count("order_id").alias("order_count"), share(F.col("is_late_delivery")).alias("late_delivery_rate"))


def sellers_enriched(items: DataFrame, orders: DataFrame) -> DataFrame:
    volume = items.where("seller_id is not null").groupBy("seller_id").agg(F.count("product_id").alias("item_count"), total(F.col("price")).alias("item_revenue"))
    return seller_lateness(items, orders).join(volume, "seller_id", "left")


def with_seller_late_rate(items: DataFrame, orders: DataFrame) -> DataFrame:
    rate = seller_lateness(items, orders).select("seller_id", F.col("late_delivery_rate").alias("seller_late_delivery_rate"))
    return items.join(rate, "seller_id", "left")


def with_customer_order_count(orders: DataFrame) -> DataFrame:
    """Distinct orders of the person on each of their rows; aggregated and joined, as no window counts distinct."""
    counts = orders.where("customer_unique_id is not null").groupBy("customer_unique_id").agg(F.count_distinct("order_id").alias("customer_order_count"))
    return orders.join(counts, "customer_unique_id", "left")


def legacy_lines(orders: DataFrame, items: DataFrame, paid: DataFrame) -> DataFrame:
    """The rows of legacy_merged() with what orders, items and payments (a row an order) tell, all met by order; what else
    it looks up, a row a key at most, changes neither rows nor these columns."""
    lines = items.where("product_id is not null")
    joined = orders.join(lines, "order_id").join(paid, "order_id", "left")
    return with_order_features(joined.withColumn("total_payment_value", F.coalesce("total_payment_value", F.col("price") + F.col("freight_value"))))


def legacy_merged(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, sellers: DataFrame, payments: DataFrame, reviews: DataFrame, translation: DataFrame) -> DataFrame:
    """The old single frame at item grain, for reproduction only: order figures repeat on every item."""
    joined = (
        orders.join(customers, "customer_id", "left")
        .join(items, "order_id", "left")
        .join(translated(products, translation), "product_id", "left")
        .join(sellers, "seller_id", "left")
        .join(payment_summary(payments), "order_id", "left")
        .join(review_summary(reviews), "order_id", "left")
        .where("product_id is not null")
    )
    filled = joined.withColumn("total_payment_value", F.coalesce("total_payment_value", F.col("price") + F.col("freight_value")))
    filled = filled.na.fill({"product_category_name_english": "Unknown", "product_category_name": "Unknown", "review_score": 0.0, "main_payment_type": "not_defined", "payment_installments": 1})
    return with_price_outliers(with_order_features(filled))


def join_cardinality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows and repeated keys of both sides and the relationship. Null counts as a key of its own."""

    def side(df: DataFrame, name: str) -> DataFrame:
        groups = df.groupBy(key).agg(F.count("*").alias("n"))
        return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"{name}_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias(f"{name}_duplicate_keys"))

    many_left, many_right = F.col("left_duplicate_keys") > 0, F.col("right_duplicate_keys") > 0
    kind = F.when(many_left & many_right, "many-to-many").when(many_left, "many-to-one").when(many_right, "one-to-many").otherwise("one-to-one")
    return side(left, "left").join(F.broadcast(side(right, "right"))).withColumn("relationship", kind)


def require_grain(df: DataFrame, *key: str) -> DataFrame:
    """df itself, or GrainError if a key (of one or more columns) repeats."""
    again = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if again:
        raise GrainError(f"{', '.join(key)} {tuple(again[0])[:-1]!r} has {again[0]['count']} rows")
    return df
