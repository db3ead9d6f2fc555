"""Broken records of source files, by hand-written files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn.sources import tables

HEAD = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
REVIEWS = HEAD + (
    'r1,o1,5,,"two\nlines, ""quoted""",2018-01-09 00:00:00,2018-01-10 00:00:00\n'
    "r2,o2,4,t,m,2018-01-09 00:00:00,2018-01-10 00:00:00,one too many\n"
    "r3,o3,high,t,m,2018-01-09 00:00:00,someday\n"
    "r4,o4,3\n"
    "r5,o5,2,t,m,,\n"
    'r6,o6,1,t,"a\nb",2018-01-09 00:00:00,2018-01-10 00:00:00,x,y\n'
)
SELLERS = "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,a,SP\ns2,2,b,RJ,more\ns3,x,c,RJ\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "x_order_reviews_dataset.csv").write_text(REVIEWS)
    (tmp_path / "x_sellers_dataset.csv").write_text(SELLERS)
    return str(tmp_path)


def test_records_are_told_apart(spark, folder):
    found = tables.records_of(spark, tables.find(spark, folder, "reviews"), "reviews")
    got = {r["review_id"]: (r["_reason"], r["_fields"] or []) for r in found.collect()}
    assert got == {"r1": (None, []), "r2": ("fields", []), "r3": ("values", ["review_score", "review_answer_timestamp"]), "r4": ("short", []), "r5": (None, []), "r6": ("fields", [])}
    kept = {r["review_id"]: r for r in tables.load(spark, folder, "reviews").collect()}
    assert set(kept) == {"r1", "r3", "r4", "r5"} and kept["r1"]["review_comment_message"] == 'two\nlines, "quoted"'
    assert kept["r3"]["review_score"] is None and kept["r3"]["review_comment_message"] == "m" and kept["r4"]["review_score"] == 3
    assert tables.load(spark, folder, "reviews").count() == 4 and tables.load(spark, folder, "sellers").select("seller_city").count() == 2
    bad = tables.quarantined(found, "reviews").where("reason = 'fields'").orderBy("record").collect()
    assert [r["record"].split(",")[0] for r in bad] == ["r2", "r6"] and all(r["file"].endswith("x_order_reviews_dataset.csv") for r in bad) and "a\nb" in bad[1]["record"]


def test_only_text_tables_are_read_whole(spark, folder):
    plan = lambda name: tables.read_csv(spark, tables.find(spark, folder, name), tables.SCHEMAS[name], name in tables.MULTI_LINE)
    assert plan("sellers").count() == 3 and plan("reviews").count() == 6


def test_quarantine_and_limit(spark, folder, tmp_path):
    for name in set(tables.FILES) - {"reviews", "sellers"}:
        (tmp_path / tables.FILES[name]).write_text(",".join(tables.columns_of(name)) + "\n")
    out = str(tmp_path / "quarantine")
    with pytest.raises(tables.BrokenSource, match="reviews: 2 of 6.*sellers: 1 of 3|sellers: 1 of 3.*reviews: 2 of 6"):
        tables.write_quarantine(spark, folder, out)
    counts = {c["table"]: c for c in tables.write_quarantine(spark, folder, out, most=0.5)}
    assert counts["reviews"] == {"table": "reviews", "rows": 6, "fields": 2, "values": 1, "short": 1} and counts["sellers"]["values"] == 1
    assert counts["orders"] == {"table": "orders", "rows": 0, "fields": 0, "values": 0, "short": 0}
    held = spark.read.parquet(out).groupBy("table", "reason").agg(F.count("*").alias("n")).collect()
    assert {(r["table"], r["reason"]): r["n"] for r in held} == {("reviews", "fields"): 2, ("reviews", "values"): 1, ("reviews", "short"): 1, ("sellers", "fields"): 1, ("sellers", "values"): 1}


def test_written_texts_come_back(spark, tmp_path):
    rows = [("a", " lead"), ("b", "trail \n"), ("c", 'say "x", y'), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "review_id string, review_comment_message string")
    tables.write_csv(df, str(tmp_path / "t.csv"))
    got = {r[0]: r[1] for r in tables.read_csv(spark, str(tmp_path / "t.csv"), "review_id string, review_comment_message string").collect()}
    assert got == {**dict(rows), "e": got["e"]} and got["e"] in (None, "")
