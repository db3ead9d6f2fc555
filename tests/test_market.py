"""Grain, null and tie rules of the marketplace operators on small tables."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import shutil
import statistics

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cairn.functions.scalars import blank, currency, cuts, negated, normalised, padded, softmax, strongest, thousands, tokens, whole_days
from cairn.functions.tails import arrangements, mann_whitney_two_sided, student_two_sided
from cairn.functions.values import region, state_name
from cairn.operators import cleaning, enrich, kpis, metrics, rfm, scoring, sentiment, stats, training
from cairn.plans.market import Market
from cairn.sources import tables

D = dt.datetime


@pytest.fixture(scope="module")
def shop(spark):
    make = spark.createDataFrame
    orders = make(
        [("o1", "c1", "delivered", D(2018, 1, 1), D(2018, 1, 5), D(2018, 1, 10)), ("o2", "c2", "delivered", D(2018, 1, 5), D(2018, 1, 10), D(2018, 1, 12)), ("o3", "c1", "canceled", D(2018, 2, 1), None, D(2018, 2, 9))],
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )
    return {
        "orders": orders,
        "customers": make([("c1", "u1", "sao paulo", "SP"), ("c2", "u2", None, "RJ")], "customer_id string, customer_unique_id string, customer_city string, customer_state string"),
        "payments": make([("o1", 1, "credit_card", 2, 200.0), ("o1", 2, "boleto", 1, 100.0), ("o2", 1, "boleto", 1, 50.0), ("o9", 1, None, 1, None)], "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double"),
        "reviews": make([("r1", "o1", 5), ("r1", "o1", 5), ("r2", "o2", 3)], "review_id string, order_id string, review_score int"),
        "items": make([("o1", 1, "p1", "s1", 100.0, 10.0), ("o1", 2, "p2", "s1", 100.0, 10.0), ("o2", 1, "p3", "s2", 50.0, 5.0), ("o2", 2, None, "s2", 9.0, 1.0)], "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double"),
        "products": make([("p1", "cat_a"), ("p2", None), ("p3", "cat_b")], "product_id string, product_category_name string"),
        "sellers": make([("s1", "SP"), ("s2", "RJ")], "seller_id string, seller_state string"),
        "translation": make([("cat_a", "category_a")], "product_category_name string, product_category_name_english string"),
    }


@pytest.fixture(scope="module")
def enriched(shop):
    return enrich.orders_enriched(shop["orders"], shop["customers"], shop["payments"], shop["reviews"]).cache()


def test_one_row_an_order_and_payments_once(enriched):
    rows = {r["order_id"]: r for r in enriched.collect()}
    assert len(rows) == 3
    assert rows["o1"]["total_payment_value"] == 300.0 and rows["o1"]["main_payment_type"] == "boleto"  # a tie: the smaller
    assert (rows["o1"]["delivery_days"], rows["o1"]["delivery_delay_days"], rows["o1"]["is_late_delivery"]) == (4, -5, False)
    assert rows["o1"]["order_day"] == "Monday" and rows["o1"]["order_year_month"] == "2018-01" and rows["o1"]["region"] == "Southeast"
    assert rows["o3"]["total_payment_value"] == 0.0 and rows["o3"]["main_payment_type"] == "not_defined" and rows["o3"]["delivery_days"] is None and rows["o3"]["is_late_delivery"] is False


def test_empty_sum_is_zero(shop):
    assert {r[0]: r[1] for r in enrich.payment_totals(shop["payments"]).collect()}["o9"] == 0.0


def test_items_fill_before_join(shop):
    rows = {(r["order_id"], r["order_item_id"]): r for r in enrich.order_items_enriched(shop["items"], shop["products"], shop["sellers"], shop["translation"]).collect()}
    assert rows["o1", 2]["product_category_name"] == "Unknown" and rows["o2", 1]["product_category_name_english"] == "Unknown"
    assert rows["o2", 2]["product_category_name"] is None and len(rows) == 4


def test_reviews_customers_sellers(shop, enriched):
    assert enrich.reviews_enriched(shop["reviews"], enriched).count() == 2
    people = {r["customer_unique_id"]: r for r in enrich.customers_enriched(shop["customers"], enriched).collect()}
    assert people["u1"]["order_count"] == 2 and people["u1"]["is_repeat_customer"] and people["u2"]["customer_city"] is None
    sellers = {r["seller_id"]: r for r in enrich.sellers_enriched(shop["items"], enriched).collect()}
    assert sellers["s1"]["order_count"] == 1 and sellers["s1"]["item_count"] == 2 and sellers["s2"]["item_count"] == 1 and sellers["s2"]["item_revenue"] == 59.0


def test_legacy_frame_inflates(shop):
    old = enrich.legacy_merged(*(shop[k] for k in ("orders", "customers", "items", "products", "sellers", "payments", "reviews", "translation")))
    assert old.count() == 3 and old.agg(F.sum("total_payment_value")).first()[0] == 650.0


def test_cardinality_and_grain(shop):
    assert enrich.join_cardinality(shop["orders"], shop["items"], "order_id").first()["relationship"] == "one-to-many"
    assert enrich.join_cardinality(shop["items"], shop["orders"], "order_id").first()["relationship"] == "many-to-one"
    enrich.require_grain(shop["orders"], "order_id")
    with pytest.raises(enrich.GrainError):
        enrich.require_grain(shop["items"], "order_id")


def test_delay_buckets_are_right_closed(spark):
    values = [-101, -100, -99, 0, 1, 5, 6, 15, 16, 100, 101, None]
    rows = spark.createDataFrame([(v,) for v in values], "delivery_delay_days int")
    got = [r[1] for r in enrich.with_delay_bucket(rows).collect()]
    a, b, c, d = enrich.DELAY_LABELS
    assert got == [None, None, a, a, b, b, c, c, d, d, None, None]


def test_days_are_floored(spark):
    base = D(2024, 1, 10)
    rows = spark.createDataFrame([(base, base + dt.timedelta(hours=h)) for h in (-5, 5, -36, 24)] + [(base, None)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in rows.select(whole_days(F.col("a"), F.col("b"))).collect()] == [-1, 0, -2, 1, None]


def test_states(spark):
    rows = spark.createDataFrame([("SP",), ("São Paulo",), ("XX",), (None,)], "s string")
    got = rows.select(state_name(F.col("s")), region(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("São Paulo", "Southeast"), ("São Paulo", "Southeast"), ("XX", None), (None, None)]


def test_cleaning(spark, shop):
    assert {(r["column"], r["missing"]) for r in cleaning.missing_values(shop["customers"], "c").collect()} == {("customer_city", 1)}
    assert cleaning.exact_duplicates({"r": shop["reviews"]}).first()["duplicate_rows"] == 1
    places = spark.createDataFrame([(1, 1.0, 2.0, None, "SP"), (1, 3.0, 4.0, "a", "SP"), (None, 0.0, 0.0, "b", "RJ")], "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string")
    assert [tuple(r) for r in cleaning.compress_places(places).collect()] == [(1, 2.0, 3.0, "a", "SP")]
    bad = cleaning.correct_types({"orders": spark.createDataFrame([("2018-01-01 10:00:00",), ("soon",)], "order_purchase_timestamp string")})["orders"]
    assert [r[0] for r in bad.collect()] == [D(2018, 1, 1, 10), None]


def test_figures(shop, enriched):
    assert kpis.monthly_revenue(enriched).collect()[0]["revenue"] == 350.0
    assert [r[0] for r in kpis.top_cities(enriched).collect()] == ["sao paulo"]  # no group for a null city
    grid = kpis.peak_hours(enriched).collect()
    assert len(grid) == 7 and grid[0]["h0"] == 1 and grid[1]["h0"] is None
    summary = kpis.business_summary(kpis.order_facts(enriched, shop["items"])).first()
    assert summary["total_unique_orders"] == 3 and summary["total_order_payment_revenue_delivered"] == 350.0 and summary["avg_review_score"] == 4.0


def test_text_rules(spark):
    rows = spark.createDataFrame([("  Café  Olé\t",), (" \t",), (None,), ("isn't",), ("NOT so",)], "t string")
    got = rows.select(normalised(F.col("t")), blank(F.col("t")), tokens(F.col("t")), negated(F.col("t"))).collect()
    assert got[0][0] == "café olé" and got[0][2] == ["café", "olé"]
    assert [r[1] for r in got] == [False, True, True, False, False]
    assert [r[3] for r in got] == [False, False, False, False, True]


def test_arrays(spark):
    one = spark.range(1)
    ids = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    got = one.select(padded(ids, 5), padded(ids, 5, before=True), padded(ids, 2), padded(F.array().cast("array<bigint>"), 3, before=True), softmax(F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert got[0] == [1, 2, 3, 0, 0] and got[1] == [0, 0, 1, 2, 3] and got[2] == [1, 2] and got[3] == [0, 0, 0] and got[4] == [0.5, 0.5]
    top = one.select(strongest(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(v).alias("value")) for t, v in (("a", 0.1), (" ", -3.0), ("b", 2.0))]), 2)).first()[0]
    assert [x["token"] for x in top] == ["b"]
    assert one.select(cuts(F.lit(0), (-1, 0), ("x",))).first()[0] == "x"


@pytest.fixture(scope="module")
def reviews(spark):
    texts = ["bad", "awful", "ok", "good", "great", "bad", "good", "great", "Terrible product", " Great  product", "terrible PRODUCT", "Great product"]
    scores = [1, 2, 3, 4, 5, 1, 4, 5, 1, 4, 1, 4]
    rows = [(f"r{i:02d}", s, t, t) for i, (s, t) in enumerate(zip(scores, texts, strict=True))]
    rows.append(("r90", 5, "No Message", ""))
    rows.append(("r91", 5, None, "fine"))
    return spark.createDataFrame(rows, "review_id string, review_score int, review_comment_message string, review_comment_message_en string")


def test_labels_and_duplicates(spark, reviews):
    frame = sentiment.labelled_reviews(reviews)
    assert frame.count() == 12  # no three stars, no message; a null raw message counts
    assert sentiment.deduplicated(frame).count() == 7
    clash = frame.unionByName(frame.where("text = 'bad'").limit(1).withColumn("label", F.lit(1)).withColumn("review_id", F.lit("x")))
    report = sentiment.deduplication_report(clash).first()
    assert (report["conflicting_label_groups"], report["conflicting_label_rows_dropped"], report["rows_after"]) == (1, 3, 6)


def test_split_sizes_and_overlap(spark):
    rows = [(f"r{i}", f"text {i}", i % 2, f"h{i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "review_id string, text string, label int, text_hash string").withColumn("normalized_text", F.col("text"))
    first = sentiment.stratified_split(frame)
    assert {r[0]: r[1] for r in first.groupBy("split").count().collect()} == {"train": 42, "val": 6, "test": 12}
    again = sentiment.stratified_split(frame.repartition(7))
    assert sorted(map(tuple, first.select("review_id", "split").collect())) == sorted(map(tuple, again.select("review_id", "split").collect()))
    assert all(r["train_val"] == r["train_test"] == r["val_test"] == 0 for r in sentiment.overlap_report(first).collect())


def test_vocabulary(spark):
    docs = spark.createDataFrame([("a", "good product"), ("b", "bad product"), ("c", "good service"), ("d", None), ("e", "")], "review_id string, text string")
    vocab = sentiment.vocabulary(docs, 5)
    assert [tuple(r)[::2] for r in vocab.orderBy("id").collect()] == [("good", 2), ("product", 3), ("bad", 4)]
    ids = {r[0]: r[1] for r in sentiment.token_ids(docs, vocab, 3).collect()}
    assert ids == {"a": [2, 3, 0], "b": [4, 3, 0], "c": [2, 1, 0], "d": [0, 0, 0], "e": [0, 0, 0]}


def test_negation_sample(spark):
    rows = [(f"{'not ' if i % 3 else ''}x{i}", int(i % 10 > 0)) for i in range(200)]
    got = sentiment.negation_sample(spark.createDataFrame(rows, "text string, label int"), total_rows=20, ratio=0.6).groupBy("is_negated", "label").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(True, 0): 6, (True, 1): 6, (False, 0): 4, (False, 1): 4}


def test_metrics_golden(spark):
    counts = spark.createDataFrame([(1942, 189, 224, 3942)], "tn long, fp long, fn long, tp long")
    r = metrics.scores(counts).first()
    assert [round(r[k], 6) for k in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "mcc")] == [0.934413, 0.925416, 0.92877, 0.927055, 0.85418]
    report = {x["class"]: x for x in metrics.class_report(counts).collect()}
    assert report["1"]["support"] == 4166 and abs(report["macro avg"]["f1"] - r["macro_f1"]) < 1e-12


def test_ranked_metrics_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (None, 0.3)], "y int, score double")
    assert metrics.roc_auc(rows).first()[0] == pytest.approx(3.5 / 6 + 0.0, abs=0.09)
    pairs = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1)]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for y, p in pairs if y for z, n in pairs if not z) / 6
    assert metrics.roc_auc(rows).first()[0] == pytest.approx(want)
    assert metrics.average_precision(rows).first()[0] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)
    assert metrics.roc_auc(rows.where("y = 1")).first()[0] is None


def test_statistics(spark):
    rows = spark.createDataFrame([(float(v), True) for v in (1, 1, 2, 3, 3)] + [(float(v), False) for v in (2, 4, 5, 5)] + [(None, True)], "v double, f boolean")
    r = stats.two_groups(rows, "v", "f").first()
    late, other = [1, 1, 2, 3, 3], [2, 4, 5, 5]
    assert r["mann_whitney_u"] == sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in late for b in other)
    assert r["n_late"] == 5 and r["median_on_time"] == 4.5
    assert student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (None, 1.0)], "a double, b double")
    got = {(x["x"], x["y"]): x["spearman"] for x in stats.spearman(pairs, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(0.8660254) and got["a", "a"] == pytest.approx(1.0)
    z = stats.standardised(pairs.na.drop(), ["a"]).orderBy("a").collect()
    assert z[0]["a"] == pytest.approx(-1.2247449)


def test_segments(spark, tmp_path):
    rows = [(f"u{i}", i % 7 + 100 * (i % 4), 1 + i % 4, float(1000 * (i % 4) + i)) for i in range(80)]
    table = spark.createDataFrame(rows, "customer_unique_id string, Recency long, Frequency long, Monetary double")
    fitted = rfm.fit_segments(table, starts=2)
    profile = {r["Segment"]: r for r in rfm.segment_profile(fitted.assign(table)).collect()}
    assert sum(r["customer_count"] for r in profile.values()) == 80
    assert profile["Champion"]["Monetary"] > profile["Loyal Customer"]["Monetary"] > profile["Potential Loyal"]["Monetary"] > profile["At Risk"]["Monetary"]
    fitted.save(spark, str(tmp_path / "seg"))
    again = rfm.Segmentation.load(spark, str(tmp_path / "seg"))
    assert again.predict(300, 4, 3001.0)["segment_name"] == "Champion"
    with pytest.raises(ValueError):
        again.predict(-5, 1, 1)


def test_models_and_gates(spark):
    rows = spark.createDataFrame([("a", "bad thing"), ("b", "good thing"), ("c", "boom")], "review_id string, text string")

    def load():
        def score(texts):
            if "boom" in texts:
                raise RuntimeError
            return [0.9 if "good" in t else 0.2 for t in texts]

        return score

    got = {r["review_id"]: r for r in scoring.full_pipeline(rows.where("text <> 'boom'"), {"sentiment": load, "fake": lambda: lambda ts: [{"label": "LABEL_0", "score": 0.7} for _ in ts]}).collect()}
    assert got["a"]["label"] == "Negative" and got["a"]["fake"]["is_fake"] and got["b"]["fake"] is None and got["b"]["aspects_reason"] == "not loaded"
    failed = scoring.sentiment(rows.where("text = 'boom'"), load).first()
    assert failed["failed"] and failed["label"] is None
    with pytest.raises(scoring.ModelUnavailable):
        scoring.require_artifact("/nowhere/model")
    with pytest.raises(scoring.InvalidRequest):
        scoring.check_request(["x"] * 69)
    with pytest.raises(scoring.InvalidRequest):
        scoring.check_request(["   "])


def test_translation_resumes(spark):
    rows = spark.createDataFrame([("bom", None), ("ruim", "bad"), ("No Message", None), (None, "")], "review_comment_message string, review_comment_message_en string")
    done = scoring.translate_step(rows, lambda: lambda ts: [t.upper() for t in ts])
    got = {r[0]: r[1] for r in done.collect()}
    assert got == {"bom": "BOM", "ruim": "bad", "No Message": None, None: "."}


def test_baseline(spark):
    rows = spark.createDataFrame([(f"r{i}", f"{'good fine' if i % 2 else 'bad poor'} thing {i}", i % 2) for i in range(40)], "review_id string, text string, label int")
    model = scoring.fit_baseline(rows)
    assert scoring.predict_baseline(rows, model).where("guess <> label").count() == 0
    top = scoring.attributions(rows.limit(1), model, 2).collect()
    assert {r["token"] for r in top} <= {"good", "fine", "bad", "poor"}


def test_quantiles_against_sorting(spark):
    r = random.Random(2)
    rows = [(r.choice(("a", "b", None)), r.choice((None, float(r.randint(0, 30)), r.random()))) for _ in range(400)] + [("lone", 5.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)

    def want(values, share):
        values = sorted(values)
        place = share * (len(values) - 1)
        low = values[math.floor(place)]
        return low + (place - math.floor(place)) * (values[math.ceil(place)] - low)

    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x["g"]: x["q"] for x in stats.quantiles(frame, "v", shares, ["g"]).collect()}
    groups = {g for g, v in rows if v is not None and g is not None}
    assert set(got) == groups
    for g in groups:
        assert got[g] == pytest.approx([want([v for k, v in rows if k == g and v is not None], s) for s in shares])
    assert stats.quantiles(frame, "v", [0.5]).first()["q"] == pytest.approx([want([v for _, v in rows if v is not None], 0.5)])
    assert stats.quantiles(frame.limit(0), "v", [0.5]).count() == 0 and enrich.with_price_outliers(frame.limit(0), "v").count() == 0
    assert {x["is_price_outlier"] for x in enrich.with_price_outliers(frame.where("v is null"), "v").collect()} == {False}


def test_fences_are_read_before_the_joins(spark):
    """As it runs, each side of the enriched items is scanned once for its rows; for the fences, items alone are counted
    by price, once (what reads the counts again shares that exchange)."""
    frame = Market(spark, "/root/testdata/sf0.001").items_enriched
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 5 and plan.count("l_extendedprice") > 0 and "percentile(" not in plan


def test_repeated_and_null_keys_keep_their_rows(spark):
    rows = [(1, "a b"), (1, "c d"), (None, "a"), (None, ""), (2, None)]
    frame = spark.createDataFrame(rows, "review_id int, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    got = sorted(((x["review_id"], x["ids"]) for x in sentiment.token_ids(frame, vocab, 3).collect()), key=repr)
    assert got == sorted([(1, [2, 3, 0]), (1, [4, 1, 0]), (None, [2, 0, 0]), (None, [0, 0, 0]), (2, [0, 0, 0])], key=repr)
    models = {"sentiment": lambda: lambda ts: [0.1] * len(ts), "aspects": lambda: lambda ps: [{"label": t, "score": 0.5} for t, _ in ps]}
    out = scoring.full_pipeline(frame, models).collect()
    assert len(out) == 5
    for x in out:
        assert (x["aspects"] is None) == (not x["text"]) and (not x["text"] or (len(x["aspects"]) == 5 and {a["sentiment"] for a in x["aspects"]} == {x["text"]}))


def test_student_tails_against_tables():
    for t, freedom, p in ((12.7062, 1, 0.05), (2.2281, 10, 0.05), (4.5869, 10, 0.001), (1.9840, 100, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5), (63.6567, 1, 0.01)):
        assert student_two_sided(t, freedom) == pytest.approx(p, rel=1e-4)
    assert student_two_sided(3.0, 1e6) == pytest.approx(0.0026998, rel=1e-3) and student_two_sided(-2.0, 10) == student_two_sided(2.0, 10)
    assert student_two_sided(40.0, 400) < 1e-100


def test_duplicates_by_hash(spark):
    rows = [("a", None), (None, "a"), ("a", None), ("ab", "c"), ("a", "bc"), (None, None), (None, None)]
    got = cleaning.exact_duplicates({"t": spark.createDataFrame(rows, "x string, y string")}).first()
    assert (got["rows"], got["duplicate_rows"]) == (7, 2)


def test_batches_are_padded_to_their_longest(spark):
    rows = [("a", "x y z", 1), ("b", "x", 0), (None, None, None), ("d", "y new", 1), ("d", "y new", 1)]
    frame = spark.createDataFrame(rows, "review_id string, text string, label int").coalesce(1)
    vocab = spark.createDataFrame([("x", 2), ("y", 3), ("z", 4)], "token string, id int")
    got = training.padded_batches(frame, vocab, 2, 2).collect()
    assert [r["keys"] for r in got] == [["a", "b"], [None, "d"], ["d"]]
    assert [r["ids"] for r in got] == [[[2, 3], [2, 0]], [[0, 0], [3, 1]], [[3, 1]]]
    assert [r["mask"] for r in got] == [[[1, 1], [1, 0]], [[0, 0], [1, 1]], [[1, 1]]] and [r["labels"] for r in got] == [[1, 0], [None, 1], [1]]
    assert [r["ids"] for r in training.padded_batches(frame.where("review_id = 'b'"), vocab, 2, 4, fixed=True).collect()] == [[[2, 0, 0, 0]]]
    assert training.padded_batches(frame.limit(0), vocab, 2, 4).count() == 0


def test_fit_stops_where_validation_gets_no_better(spark):
    r = random.Random(4)
    noisy = [(f"{'good' if y else 'bad'} w{r.randint(0, 400)} w{r.randint(0, 400)}", y if r.random() < 0.8 else 1 - y) for _ in range(300) for y in (int(r.random() < 0.25),)]
    train, val = (spark.createDataFrame(part, "text string, label int") for part in (noisy[:200], noisy[200:] + [("good", None)]))
    fitted = training.fit_stopping(train, val, rounds=(1, 2, 4, 8, 16, 32, 64), patience=2, strength=0.0, smoothing=0.05)
    losses = [h["val_loss"] for h in fitted.history]
    assert fitted.best == losses.index(min(losses)) + 1 and len(losses) in (fitted.best + 2, 7)
    assert fitted.history[-1]["loss"] < fitted.history[0]["loss"] and fitted.model is not None
    assert scoring.predict_baseline(spark.createDataFrame([("good",), ("bad",)], "text string"), fitted.model).select("guess").collect() == [(1,), (0,)]
    with pytest.raises(ValueError):
        training.fit_stopping(train, val.limit(0))


def test_translation_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{n}", f"t{n}" if n % 3 else None, None) for n in range(20)] + [("r1", "again", None), (None, "x", "done")], "review_id string, review_comment_message string, review_comment_message_en string")
    at = str(tmp_path / "t")

    def broken():
        raise RuntimeError("no worker")

    first = scoring.translate_step(rows.where(F.pmod(F.xxhash64("review_id"), F.lit(3)) == 0), lambda: lambda ts: ["first"] * len(ts))
    first.write.parquet(f"{at}/step-00000")
    with pytest.raises(Exception, match="no worker"):
        scoring.translate_in_steps(rows, broken, at, steps=3)
    done = scoring.translate_in_steps(rows, lambda: lambda ts: ["second"] * len(ts), at, steps=3)
    words = [r["review_comment_message_en"] for r in done.collect()]
    assert len(words) == 22 and words.count("first") == first.where("review_comment_message_en = 'first'").count() > 0 and set(words) == {"first", "second", "done"}
    assert scoring.translate_in_steps(rows, broken, at, steps=3).count() == 22


def test_samples_and_explanations(spark):
    rows = spark.createDataFrame([(n % 30, f"{'good' if n % 2 else 'bad'} thing", n % 2) for n in range(40)] + [(None, "good good", 1), (99, " ", 0)], "review_id int, text string, label int")
    load = lambda: lambda pairs: [{"label": "Neutral", "score": 0.5} for _ in pairs]
    some = scoring.sampled_aspects(rows, load, "review_id", "text", sample=4)
    assert some.count() == 20 and sorted(some.collect(), key=repr) == sorted(scoring.sampled_aspects(rows.repartition(3), load, "review_id", "text", sample=4).collect(), key=repr)
    assert scoring.sampled_aspects(rows, load, "review_id", "text", sample=1000).count() == 41 * 5
    model = scoring.fit_baseline(rows)
    told = scoring.explained(rows, model, 1).collect()
    assert len(told) == 42 and all([t["token"] for t in x["top_tokens"]] == ([x["text"].split()[0]] if x["text"].strip() else []) for x in told)
    twice = {x["text"]: x["top_tokens"][0]["value"] for x in told if x["text"].strip()}
    assert twice["good good"] == pytest.approx(2 * twice["good thing"])
    assert scoring.attributions(rows.where("review_id = 3"), model, 1).count() == 2  # a key that repeats keeps its rows apart
    assert scoring.sampled_explanations(rows, model, sample=5).count() == 5


def test_artifacts_and_served_columns(spark, tmp_path):
    good = tmp_path / "m.txt"
    good.write_text("3")
    assert scoring.loaded(str(good), lambda p: int(open(p).read())) == 3
    for path, load in ((str(tmp_path / "none"), str), (str(good), lambda p: [][1])):
        with pytest.raises(scoring.ModelUnavailable):
            scoring.loaded(path, load)
    base = str(tmp_path / "out")
    spark.createDataFrame([(1, "x", 2.0)], "order_id int, customer_city string, total double").write.parquet(f"{base}/orders_enriched.parquet")
    found = tables.served(spark, base)
    assert set(found) == {"orders_enriched"} and found["orders_enriched"].columns == ["order_id", "customer_city"]
    assert "total" not in found["orders_enriched"]._jdf.queryExecution().executedPlan().toString()
    told = tables.describe_path(spark, base)
    assert told["exists"] and told["size_bytes"] > 0 and tables.describe_path(spark, base + "x") == {"exists": False, "path": base + "x"}


def test_narrow_types_and_formats(spark):
    rows = [(1, 300, 2**40, 1.5, 0.1, None), (-128, None, 1, -2.0, 0.2, None)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d double, e double, f bigint")
    narrow = cleaning.narrowed(frame)
    assert dict(narrow.dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float", "e": "double", "f": "bigint"}
    assert [tuple(r) for r in narrow.collect()] == rows and dict(cleaning.narrowed(frame.limit(0)).dtypes) == dict(frame.dtypes)
    money = spark.createDataFrame([(1234.5,), (-0.001,), (-1234.565,), (1000000.0,), (None,)], "v double")
    assert [tuple(r) for r in money.select(currency(F.col("v")), thousands(F.col("v"))).collect()] == [("R$1,234.50", "1,234.5"), ("R$0.00", "-0.001"), ("-R$1,234.57", "-1,234.565"), ("R$1,000,000.00", "1,000,000"), (None, None)]


def test_shuffle_is_the_seeded_order(spark):
    frame = spark.range(50).repartition(5)
    once, again, other = ([r[0] for r in sentiment.shuffled(frame, "id", s).collect()] for s in (1, 1, 2))
    assert once == again != other and sorted(once) == list(range(50))


def test_rank_statistics_against_brute_force(spark):
    """Null-heavy columns with ties: every pair's rank correlation, group descriptions and the two groups' report."""
    r = random.Random(8)
    data = [tuple(None if r.random() < 0.4 else float(r.choice((r.randint(0, 5), r.randint(0, 1000)))) for _ in range(4)) + (r.choice(("x", "y", None)), r.choice((True, False, None))) for _ in range(400)] + [(None,) * 6]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, g string, f boolean").repartition(5)
    ranks = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]

    def correlation(xs, ys):
        mx, my = statistics.fmean(xs), statistics.fmean(ys)
        return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))

    for x in stats.spearman(df, ["a", "b", "c", "d"]).collect():
        i, j = "abcd".index(x["x"]), "abcd".index(x["y"])
        both = [(t[i], t[j]) for t in data if t[i] is not None and t[j] is not None]
        assert x["spearman"] == pytest.approx(correlation(ranks([p for p, _ in both]), ranks([q for _, q in both])))
    assert stats.spearman(df, ["a", "b", "c", "d"]).count() == 16
    assert stats.spearman(df.where("false"), ["a", "b"]).count() == 0
    only = df.where("a is not null and b is null")
    assert {(x["x"], x["y"]) for x in stats.spearman(only, ["a", "b"]).collect()} == {("a", "a")}
    for x in kpis.described(df, "g", ["a", "d"]).collect():
        own = sorted(t["ad".index(x["column"]) * 3] for t in data if t[4] == x["g"] and t["ad".index(x["column"]) * 3] is not None)
        quarters = statistics.quantiles(own, n=4, method="inclusive")
        assert [x[c] for c in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx([len(own), statistics.fmean(own), statistics.stdev(own), own[0], *quarters, own[-1]])
    late, other = ([t[0] for t in data if t[5] is f and t[0] is not None] for f in (True, False))
    x = stats.two_groups(df, "a", "f").first()
    u = sum((p > q) + (p == q) / 2 for p in late for q in other)
    assert x["mann_whitney_u"] == pytest.approx(u) and x["n_late"] == len(late) and x["median_late"] == statistics.median(late) and x["std_on_time"] == pytest.approx(statistics.stdev(other))
    none = stats.two_groups(df.where("false"), "a", "f").first()
    assert none["n_late"] == 0 and none["median_late"] is None and none["welch_t"] is None


def test_statistics_read_once_and_run_nothing_while_built(spark):
    df = spark.range(300).select(*[((F.col("id") * p) % 97).cast("double").alias(c) for c, p in (("a", 3), ("b", 5), ("c", 7))], (F.col("id") % 2 == 0).alias("f"))
    spark.sparkContext.setJobGroup("built", "")
    frames = [stats.spearman(df, ["a", "b", "c"]), stats.distributions(df, ["a", "b", "c"], [0.5], ["f"]), stats.two_groups(df, "a", "f"), metrics.roc_auc(df.select(F.col("f").cast("int").alias("y"), F.col("a").alias("score")))]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setJobGroup("run", "")
    for frame, most in zip(frames, (2, 1, 1, 2), strict=True):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Range (0, 300") <= most, plan


def test_summary_reads_lines_once(spark):
    found = Market(spark, "/root/testdata/sf0.001").order_facts
    plan = kpis.business_summary(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") > 0 and plan.count("] parquet") == 3
    none = kpis.business_summary(found.where("false")).first()
    assert none["total_unique_orders"] == 0 and none["late_delivery_rate_pct"] is None and none["order_status_distribution"] == []
    rows = [("o1", "p", "delivered", 5.0, 0.0, True, 7.0, [1, 2]), ("o2", "p", None, 6.0, 4.0, False, None, None), (None, None, None, None, None, None, 3.0, [2, 9]), ("o3", None, "delivered", 1.0, 5.0, True, 1.0, [1])]
    x = kpis.business_summary(spark.createDataFrame(rows, "known_order string, customer_unique_id string, order_status string, total_payment_value double, review_score double, is_late_delivery boolean, item_revenue double, sellers array<int>"), "delivered").first()
    assert (x["total_unique_orders"], x["total_unique_customers"], x["total_unique_sellers"], x["total_item_revenue"], x["total_order_payment_revenue_delivered"]) == (3, 1, 3, 11.0, 6.0)
    assert x["avg_review_score"] == 4.5 and x["repeat_customer_rate_pct"] == 100 and x["late_delivery_rate_pct"] == pytest.approx(200 / 3) and [tuple(s) for s in x["order_status_distribution"]] == [("delivered", 2)]


def test_edges_are_counted_in_two_steps(spark):
    edges = [float(n) for n in range(200)]
    values = [-1.0, 0.0, 0.5, 31.0, 31.5, 32.0, 33.0, 150.2, 199.0, 500.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for some in (edges, edges[:32], edges[:1], []):
        got = [x[0] for x in frame.select(stats._below(F.lit(some).cast("array<double>"), F.col("v"))).collect()]
        assert got == [sum(e < v for e in some) for v in values]


def test_exact_mann_whitney():
    """Every arrangement of up to six untied rows."""
    for n1 in range(1, 6):
        for n2 in range(1, 7 - n1 + 1):
            us = [sum(a > b for a in late for b in set(range(n1 + n2)) - set(late)) for late in itertools.combinations(range(n1 + n2), n1)]
            assert arrangements(n1, n2) == [us.count(u) for u in range(n1 * n2 + 1)]
            for u in set(us):
                top = max(u, n1 * n2 - u)
                assert mann_whitney_two_sided(u, n1, n2, 0) == pytest.approx(min(1.0, 2 * sum(x >= top for x in us) / len(us)))
    assert sum(arrangements(8, 30)) == math.comb(38, 8)
    assert mann_whitney_two_sided(200, 20, 20, 0) == 1.0 and mann_whitney_two_sided(3, 2, 3, 6.0) < 1.01
    assert mann_whitney_two_sided(400, 20, 20, 0) == pytest.approx(math.erfc((200 - 0.5) / math.sqrt(20 * 20 / 12 * 41) / math.sqrt(2)))


def test_significance_of_few_untied_rows(spark):
    df = spark.createDataFrame([(float(v), v in (1, 2, 4), 1.0) for v in range(1, 9)], "review_score double, is_late_delivery boolean, delivery_delay_days double")
    r = stats.late_significance(df)
    assert r["mann_whitney_u_test"] == {"statistic": 1.0, "p_value": pytest.approx(2 * 2 / math.comb(8, 3))}


def test_all_starts_of_kmeans_share_their_passes(spark):
    r = np.random.default_rng(3)
    hubs = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [30, 30]])
    x = np.vstack([h + r.normal(size=(60, 2)) for h in hubs])
    rows = [(float(a), float(b)) for a, b in x]
    df = spark.createDataFrame([*rows, (None, 1.0)], "a double, b double").repartition(4)
    centres, cost, costs = rfm.kmeans(df, 5, starts=6)
    assert len(costs) == 6 and cost == min(costs)
    near = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert cost == pytest.approx(near.min(1).sum())
    assert centres == pytest.approx(np.array([x[near.argmin(1) == k].mean(0) for k in range(5)]), abs=1e-3)  # a rest point
    assert sorted(map(tuple, np.round(centres / 10).astype(int).tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (3, 3)]
    again, *_ = rfm.kmeans(df.repartition(3), 5, starts=6)
    assert np.sort(again, axis=0) == pytest.approx(np.sort(centres, axis=0))
    frame = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.na.drop())
    assert cost <= 1.0001 * min(KMeans(k=5, seed=n).fit(frame).summary.trainingCost for n in range(3))
    same, cost, _ = rfm.kmeans(spark.createDataFrame([(1.0, 2.0)] * 9, "a double, b double"), 3, starts=2)
    assert cost == 0 and {(1.0, 2.0)} <= {tuple(c) for c in same.tolist()}
    with pytest.raises(ValueError):
        rfm.kmeans(df.where("false"), 2)
    spark.sparkContext.setJobGroup("few", "")
    rfm.kmeans(df, 5, starts=1, iterations=2)
    few = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("many", "")
    rfm.kmeans(df, 5, starts=9, iterations=2)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many")) <= few + 2
    spark.sparkContext.setJobGroup("other", "")


def test_translation_reads_its_source_once(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(f"r{n}", f"t{n}", None) for n in range(12)] + [(None, "x", None)], "review_id string, review_comment_message string, review_comment_message_en string").write.parquet(source)

    def stop():
        raise RuntimeError("no worker")

    with pytest.raises(Exception, match="no worker"):
        scoring.translate_in_steps(spark.read.parquet(source), stop, str(tmp_path / "t"), steps=3)
    shutil.rmtree(source)
    reviews = spark.createDataFrame([], "review_id string, review_comment_message string, review_comment_message_en string")
    done = scoring.translate_in_steps(reviews, lambda: lambda ts: [t.upper() for t in ts], str(tmp_path / "t"), steps=3)
    assert sorted(r["review_comment_message_en"] for r in done.collect()) == sorted([f"T{n}" for n in range(12)] + ["X"])
