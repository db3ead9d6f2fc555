"""The batch run: source files to cleaned and enriched tables, a segmentation and result documents, for serving."""

from __future__ import annotations

import datetime
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning, enrich, kpis, rfm, stats
from ..sources import results, tables
from ..sources.scratch import delete
from .market import Market

#: The grain of enriched tables: one row for each value of these columns. Items are not guarded: theirs is the source's.
GRAIN = {"orders_enriched": ["order_id"], "reviews_enriched": ["review_id"], "customers_enriched": ["customer_unique_id"], "sellers_enriched": ["seller_id"]}
DOCUMENTS = ("business_summary", "monthly_orders", "monthly_revenue", "review_scores", "delivery_summary", "payment_methods", "customer_summary", "top_cities", "seller_summary", "late_sellers", "top_categories", "late_by_state", "late_significance", "rfm_summary")


class SourceMarket(Market):
    """The entity tables of a folder of source CSV files, typed and cleaned."""

    delivered, failed = kpis.DELIVERED, kpis.FAILED

    @cached_property
    def _cleaned(self) -> dict[str, DataFrame]:
        loaded = cleaning.correct_types(tables.load_all(self.spark, self.sf_dir))
        loaded = cleaning.drop_duplicate_rows(loaded)
        loaded["products"] = cleaning.clean_products(loaded["products"])
        loaded["reviews"] = cleaning.clean_reviews(loaded["reviews"])
        for name, column in (("customers", "customer_state"), ("sellers", "seller_state")):
            loaded[name] = cleaning.name_states(loaded[name], column)
        return loaded

    orders = property(lambda self: self._cleaned["orders"])
    customers = property(lambda self: self._cleaned["customers"])
    items = property(lambda self: self._cleaned["items"])
    payments = property(lambda self: self._cleaned["payments"])
    reviews = property(lambda self: self._cleaned["reviews"])
    products = property(lambda self: self._cleaned["products"])
    sellers = property(lambda self: self._cleaned["sellers"])
    translation = property(lambda self: self._cleaned["translation"])

    @cached_property
    def order_facts(self) -> DataFrame:
        return kpis.order_facts(self.orders_enriched, self.items)

    @cached_property
    def places(self) -> DataFrame:
        return cleaning.compress_places(self._cleaned["geolocation"])


class PreparedMarket(Market):
    """The enriched tables of one run's folder (current() names the published one): figures come without a join."""

    def __init__(self, spark: SparkSession, base: str, like: Market | type[Market] = SourceMarket) -> None:
        super().__init__(spark, base)
        self.delivered, self.failed = like.delivered, like.failed

    orders_enriched = property(lambda self: self.table("orders_enriched"))
    items_enriched = property(lambda self: self.table("order_items_enriched"))
    reviews_enriched = property(lambda self: self.table("reviews_enriched"))
    customers_enriched = property(lambda self: self.table("customers_enriched"))
    sellers_enriched = property(lambda self: self.table("sellers_enriched"))
    items = items_categorised = items_enriched
    order_facts = property(lambda self: kpis.order_facts(self.orders_enriched, self.items))


def enriched(market: Market) -> dict[str, DataFrame]:
    return {"orders_enriched": market.orders_enriched, "order_items_enriched": market.items_enriched, "reviews_enriched": market.reviews_enriched, "customers_enriched": market.customers_enriched, "sellers_enriched": market.sellers_enriched}


def documents(market: Market, segmentation: rfm.Segmentation) -> dict[str, object]:
    """All report documents by name; each is small."""
    rows, o = results.records, market.orders_enriched
    return {
        "business_summary": rows(kpis.business_summary(market.order_facts, market.delivered))[0],
        "monthly_orders": rows(kpis.monthly_orders(o)),
        "monthly_revenue": rows(kpis.monthly_revenue(o, market.delivered)),
        "review_scores": rows(kpis.review_scores(o)),
        "delivery_summary": rows(kpis.delivery_summary(o))[0],
        "payment_methods": rows(kpis.counts(o, "main_payment_type")),
        "customer_summary": rows(kpis.customer_summary(market.customers_enriched))[0],
        "top_cities": rows(kpis.top_cities(o)),
        "seller_summary": rows(kpis.seller_summary(market.sellers_enriched))[0],
        "late_sellers": rows(kpis.late_sellers(market.sellers_enriched, 20)),
        "top_categories": rows(kpis.top_categories(market.items_categorised, 15)),
        "late_by_state": rows(kpis.late_by_state(o)),
        "late_significance": results.safe(stats.late_significance(o)),
        "rfm_summary": rows(rfm.segment_profile(segmentation.assign(rfm.rfm_table(o)))),
    }


#: The file that names the run whose results are served.
CURRENT = "CURRENT"


def current(spark: SparkSession, out: str) -> str:
    """The folder of the published run below `out`; FileNotFoundError where none is."""
    pointer = f"{out}/{CURRENT}"
    if not tables.exists(spark, pointer):
        raise FileNotFoundError(f"no run is published in {out}")
    return f"{out}/runs/{spark.read.text(pointer, wholetext=True).first()[0].strip()}"


def prune(spark: SparkSession, out: str, keep: int = 2) -> None:
    """Deletes all but the `keep` newest runs; the published one stays in any case, so do runs that are newer than it."""
    fs, at = tables._fs(spark, f"{out}/runs")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at))
    published = current(spark, out).rsplit("/", 1)[1]
    for name in names[: max(0, len(names) - keep)]:
        if name < published:
            delete(spark, f"{out}/runs/{name}")


def run(market: Market, out: str, most_broken: float = 0.01) -> PreparedMarket:
    """Writes enriched tables, segmentation and documents to a folder of their own below `out`, then publishes them all
    at once, and returns the prepared tables.

    What has been published before stays so until then: a run that is stopped, or refused because a key repeats
    (GrainError) or a source has too many broken records (BrokenSource; they are written beside the tables), changes no
    answer. Grains are checked on the written keys, before figures are taken. Tables are written once and reread, so the
    figures after them join nothing."""
    spark = market.spark
    name = f"{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    at = f"{out}/runs/{name}"
    counts = tables.write_quarantine(spark, market.sf_dir, f"{at}/quarantine", most_broken) if isinstance(market, SourceMarket) else []
    tables.write_tables(enriched(market), at)
    prepared = PreparedMarket(spark, at, market)
    held = enriched(prepared)
    for table_name, key in GRAIN.items():
        enrich.require_grain(held[table_name], *key)
    table = rfm.rfm_table(prepared.orders_enriched)
    segmentation = rfm.fit_segments(table)
    segmentation.save(spark, f"{at}/segmentation")
    for document, payload in documents(prepared, segmentation).items():
        results.write_json(spark, f"{at}/{document}.json", payload if isinstance(payload, dict) else {"rows": payload})
    results.write_json(spark, f"{at}/source_counts.json", {"rows": counts})
    results.publish(spark, f"{out}/{CURRENT}", name)
    prune(spark, out)
    return prepared
