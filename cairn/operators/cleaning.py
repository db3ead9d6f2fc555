"""Audits and cleaning of the source tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.values import NO_MESSAGE, NO_TITLE, state_name

# Columns of the sources, in their spelling.
#: Numeric product attributes that are filled with 0.
PRODUCT_NUMBERS = ("product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
TIMES = {
    "orders": ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"),
    "items": ("shipping_limit_date",),
    "reviews": ("review_creation_date", "review_answer_timestamp"),
}
INTEGERS = {"products": ("product_name_lenght", "product_description_lenght", "product_photos_qty")}


def exact_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, duplicate_rows: rows that repeat an earlier one in full.

    Rows go by two 64-bit hashes and which of their columns are null, so long texts are not shuffled."""

    def count(name: str, df: DataFrame) -> DataFrame:
        values = [F.col(f"`{c}`") for c in df.columns]
        empty = F.concat_ws("", *[F.when(v.isNull(), "1").otherwise("0") for v in values])
        groups = df.select(empty.alias("e"), F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b")).groupBy("e", "a", "b").agg(F.count("*").alias("n"))
        return groups.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))

    return reduce(DataFrame.unionByName, [count(k, v) for k, v in tables.items()])


def drop_duplicate_rows(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: v.distinct() for k, v in tables.items()}


def missing_values(df: DataFrame, table: str) -> DataFrame:
    """table, column, missing: columns with at least one null, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns])).alias("x")
    return counts.select(pairs).select(F.lit(table).alias("table"), "x.column", "x.missing").where("missing > 0")


def clean_products(products: DataFrame) -> DataFrame:
    return products.na.fill({"product_category_name": "unknown"} | {c: 0 for c in PRODUCT_NUMBERS if c in products.columns})


def clean_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.na.fill({"review_comment_title": NO_TITLE, "review_comment_message": NO_MESSAGE})


def correct_types(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Times from text (null where unreadable) and whole numbers as bigint."""
    out = dict(tables)
    for name, columns in TIMES.items():
        if name in out:
            kinds = dict(out[name].dtypes)
            out[name] = out[name].withColumns({c: F.expr(f"try_cast(`{c}` as timestamp_ntz)") for c in columns if c in kinds and kinds[c] == "string"})
    for name, columns in INTEGERS.items():
        if name in out:
            out[name] = out[name].withColumns({c: F.expr(f"try_cast(`{c}` as bigint)") for c in columns if c in out[name].columns})
    return out


def compress_places(places: DataFrame, key: str = "geolocation_zip_code_prefix", averages: tuple[str, ...] = ("geolocation_lat", "geolocation_lng"), firsts: tuple[str, ...] = ("geolocation_city", "geolocation_state"), order: tuple[str, ...] | None = None) -> DataFrame:
    """One row a key: means, and the first non-null value of each of `firsts` by `order` (all columns, if not given)."""
    by = F.struct(*[F.col(c) for c in (order or (*averages, *firsts))])
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in firsts]
    return places.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(c).alias(c) for c in averages], *first)


def name_states(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, state_name(F.col(column)))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an explicit order (nulls of the key form one key)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


#: Whole-number types by the largest value they hold.
WHOLE = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1}


def narrowed(df: DataFrame) -> DataFrame:
    """Whole numbers in the narrowest type that holds their column, doubles as floats where no value changes by that.

    One aggregate over the table decides. Columns of nulls alone stay as they are."""
    kinds = dict(df.dtypes)
    whole, real = [c for c, t in kinds.items() if t in ("bigint", "int", "smallint")], [c for c, t in kinds.items() if t == "double"]
    if not whole and not real:
        return df
    same = lambda c: F.min(F.col(f"`{c}`").cast("float").cast("double").eqNullSafe(F.col(f"`{c}`")))
    facts = df.agg(*[x for c in whole for x in (F.min(f"`{c}`"), F.max(f"`{c}`"))], *[x for c in real for x in (same(c), F.count(f"`{c}`"))]).first()
    found = {c: (facts[2 * n], facts[2 * n + 1]) for n, c in enumerate([*whole, *real])}
    to = {c: next((t for t, top in WHOLE.items() if found[c][0] >= -top - 1 and found[c][1] <= top), kinds[c]) for c in whole if found[c][0] is not None}
    to |= {c: "float" for c in real if found[c][0] and found[c][1]}
    return df.select(*[F.col(f"`{c}`").cast(to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in df.columns])


def memory_report(before: DataFrame, after: DataFrame) -> dict[str, float]:
    """Catalyst's size estimates in MB, as before and after narrowed()."""
    size = lambda df: float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20
    return {"before_mb": size(before), "after_mb": size(after)}
