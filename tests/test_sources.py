from __future__ import annotations

import json

import pytest

from cairn.sources import results, tables


def test_csv_with_quotes_and_missing(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / ("any_" + tables.FILES["reviews"])).write_text('review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\nr1,o1,5,,"line one\nline ""two""",2018-01-01 00:00:00,\n')
    row = tables.load(spark, base, "reviews").first()
    assert row["review_comment_message"] == 'line one\nline "two"' and row["review_comment_title"] is None
    found = {x["table"]: x for x in tables.validate(spark, base)}
    assert found["reviews"]["ok"] and found["reviews"]["row_count"] == 1 and not found["orders"]["ok"]
    with pytest.raises(FileNotFoundError):
        tables.load_all(spark, base)
    with pytest.raises(FileNotFoundError):
        tables.resolve_base(spark, base)
    (tmp_path / "a.csv").write_text("reviews.text,reviews.rating,x\nfine,5,1\nbad,,2\n")
    assert tables.read_ratings(spark, [f"{base}/a.csv", f"{base}/none.csv"]).count() == 2


def test_results(spark, tmp_path):
    results.write_json(spark, str(tmp_path / "kpis.json"), {"x": float("nan"), "schema_version": "2"})
    got = json.loads((tmp_path / "kpis.json").read_text())
    assert got["x"] is None and got["schema_version"] == "2" and "generated_at" in got
    held = results.Results(spark, str(tmp_path), ("kpis", "none"))
    assert held.available() == ["kpis"] and held.get("none") is None and held.is_ready()
    df = spark.range(3)
    tables.write_tables({"t": df}, str(tmp_path))
    assert tables.scan(spark, f"{tmp_path}/t.parquet", ["id"]).count() == 3
    assert tables.artifacts(spark, str(tmp_path)).count() > 0
    with pytest.raises(ValueError):
        results.records(df, 2)
