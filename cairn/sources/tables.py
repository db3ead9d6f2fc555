"""Source tables: explicit schemas, CSV and Parquet scans, validation, sinks."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# The source files' columns, by the data set's own names.
SCHEMAS = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_city string, customer_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string",
    "items": "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date timestamp_ntz, price double, freight_value double",
    "payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double",
    "reviews": "review_id string, order_id string, review_score int, review_comment_title string, review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "products": "product_id string, product_category_name string, product_name_lenght bigint, product_description_lenght bigint, product_photos_qty bigint, product_weight_g double, product_length_cm double, product_height_cm double, product_width_cm double",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "translation": "product_category_name string, product_category_name_english string",
}
# How the source files' names end; what stands before (and an underscore) is the data set's own.
FILES = {
    "customers": "customers_dataset.csv",
    "geolocation": "geolocation_dataset.csv",
    "items": "order_items_dataset.csv",
    "payments": "order_payments_dataset.csv",
    "reviews": "order_reviews_dataset.csv",
    "orders": "orders_dataset.csv",
    "products": "products_dataset.csv",
    "sellers": "sellers_dataset.csv",
    "translation": "category_name_translation.csv",
}


def columns_of(name: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[name].split(", ")]


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's file systems, so any store that Spark reads will do."""
    fs, at = _fs(spark, path)
    return fs.exists(at)


def find(spark: SparkSession, base: str, name: str) -> str | None:
    """The file of a source table in a folder, with or without a prefix to its name; the first by name, if several."""
    fs, at = _fs(spark, f"{base}/*{FILES[name]}")
    found = [f.getPath() for f in fs.globStatus(at) or []]
    fitting = sorted(str(x.toString()) for x in found if x.getName() == FILES[name] or x.getName().endswith("_" + FILES[name]))
    return fitting[0] if fitting else None


def resolve_base(spark: SparkSession, path: str | None = None, fallback: str = "data/raw") -> str:
    """The folder of the CSV files: the argument, else MARKET_DATA_DIR, else `fallback`; one without orders is an error."""
    for base in (path, os.environ.get("MARKET_DATA_DIR"), fallback):
        if base and find(spark, base, "orders"):
            return base
    raise FileNotFoundError("no folder with the source files was found")


def discover(spark: SparkSession, base: str) -> dict[str, str]:
    return {k: path for k in FILES if (path := find(spark, base, k))}


#: Tables whose texts may hold line ends. Only their files are read as a whole by one task; the others are split.
MULTI_LINE = ("reviews",)
#: Column of a record that was not read as it stands, and what a field too many is read as.
BROKEN, MORE = "_broken", "_more"


class BrokenSource(ValueError):
    """A source table has more broken records than its run allows."""


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Quoted newlines (where multi_line) and doubled quotes are part of fields."""
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def records_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A source file's columns and, for records that were not read as they stand, `_broken` (their text), `_file`,
    `_reason` and `_fields`: `fields` where there are more than the table has, `values` with the columns whose value is
    none of their type, `short` where fields are missing at the end. Others have nulls there.

    Fields that are missing or of another type are null, as ever; an empty field too many is none."""
    raw = spark.read.options(header=True, multiLine=name in MULTI_LINE, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, columnPruning=False)
    columns = columns_of(name)
    strings = ", ".join(f"{c} string" for c in [*columns, MORE])
    read = raw.schema(f"{SCHEMAS[name]}, {BROKEN} string").csv(path).withColumn("_file", F.col("_metadata.file_path"))
    as_text = F.from_csv(F.col(BROKEN), F.lit(strings), {"quote": '"', "escape": '"', "multiLine": "true"})
    wrong = F.filter(F.array(*[F.when(F.col("_text")[c].isNotNull() & F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    known = F.col(BROKEN).isNotNull()
    told = read.withColumn("_text", F.when(known, as_text)).withColumn("_wrong", F.when(known, wrong))
    reason = F.when(F.col("_text")[MORE].isNotNull(), "fields").when(F.size("_wrong") > 0, "values").when(known, "short")
    return told.select(*columns, BROKEN, "_file", reason.alias("_reason"), F.col("_wrong").alias("_fields"))


def sound(records: DataFrame, name: str) -> DataFrame:
    """The table without the records that have fields too many."""
    return records.where(~F.col("_reason").eqNullSafe("fields")).select(*columns_of(name))


def quarantined(records: DataFrame, name: str) -> DataFrame:
    """table, file, reason, fields, record of the records that were not read as they stand; those of reason `fields` are
    not in the table, the others are, with nulls."""
    return records.where(F.col("_reason").isNotNull()).select(F.lit(name).alias("table"), F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col("_fields").alias("fields"), F.col(BROKEN).alias("record"))


def record_counts(records: DataFrame, name: str) -> DataFrame:
    """One row: table, rows (as read), and how many of them have each reason."""
    return records.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), *[F.count_if(F.col("_reason") == r).alias(r) for r in ("fields", "values", "short")])


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    path = find(spark, base, name)
    if path is None:
        raise FileNotFoundError(f"no file {FILES[name]} in {base}")
    return sound(records_of(spark, path, name), name)


def _found(spark: SparkSession, base: str) -> dict[str, str]:
    found = discover(spark, base)
    missing = sorted(set(FILES) - set(found))
    if missing:
        raise FileNotFoundError(f"missing source files: {', '.join(FILES[m] for m in missing)}")
    return found


def load_all(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {k: sound(records_of(spark, path, k), k) for k, path in _found(spark, base).items()}


def write_quarantine(spark: SparkSession, base: str, out: str, most: float = 0.01) -> list[dict]:
    """Writes the records that were not read as they stand to `out` and returns the counts by table; BrokenSource, once
    that is written, where more than the share `most` of a table's records have fields too many."""
    records = {k: records_of(spark, path, k) for k, path in _found(spark, base).items()}
    reduce(DataFrame.unionByName, [quarantined(r, k) for k, r in records.items()]).write.mode("overwrite").partitionBy("table").parquet(out)
    counts = [r.asDict() for r in reduce(DataFrame.unionByName, [record_counts(r, k) for k, r in records.items()]).collect()]  # a row a table
    bad = [c for c in counts if c["fields"] > most * c["rows"]]
    if bad:
        raise BrokenSource("; ".join(f"{c['table']}: {c['fields']} of {c['rows']} records have fields too many" for c in bad) + f"; they are in {out}")
    return counts


def validate(spark: SparkSession, base: str) -> list[dict]:
    """Per table: ok, missing_columns, row_count (records, so newlines in fields do not count)."""
    out, found = [], discover(spark, base)
    for name in FILES:
        if name not in found:
            out.append({"table": name, "ok": False, "missing_columns": columns_of(name), "row_count": 0})
            continue
        df = read_csv(spark, found[name], multi_line=name in MULTI_LINE)
        missing = [c for c in columns_of(name) if c not in df.columns]
        out.append({"table": name, "ok": not missing, "missing_columns": missing, "row_count": df.count()})
    return out


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan; the column list reaches the reader as its schema."""
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


#: The columns of enriched tables that answers are made from.
SERVED = {
    "orders_enriched": ["order_id", "customer_city"],
    "customers_enriched": ["customer_unique_id", "is_repeat_customer", "order_count", "total_spend"],
    "sellers_enriched": ["seller_id", "late_delivery_rate", "item_revenue", "order_count"],
}


def served(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The enriched tables that exist below base, each with its served columns only."""
    return {n: scan(spark, f"{base}/{n}.parquet", c) for n, c in SERVED.items() if exists(spark, f"{base}/{n}.parquet")}


def read_ratings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """text, rating of the files that exist; none is an error. The files' columns have dots in their names."""
    found = [read_csv(spark, p).select(F.col("`reviews.text`").alias("text"), F.expr("try_cast(`reviews.rating` as double)").alias("rating")) for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of these files exists: {paths}")
    return reduce(DataFrame.unionByName, found)


def translation_cache(spark: SparkSession, path: str) -> DataFrame | None:
    return read_csv(spark, path, SCHEMAS["reviews"] + ", review_comment_message_en string") if exists(spark, path) else None


def write_tables(tables: dict[str, DataFrame], base: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def artifacts(spark: SparkSession, base: str) -> DataFrame:
    """path, length of every file below base, largest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return files.select("path", "length").orderBy(F.desc("length"), "path")


def describe_path(spark: SparkSession, path: str) -> dict:
    """Whether a path exists and the bytes of its files, without reading them."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return {"exists": False, "path": path}
    size = int(fs.getContentSummary(at).getLength())
    return {"exists": True, "path": path, "size_bytes": size, "size_mb": round(size / 2**20, 2)}
