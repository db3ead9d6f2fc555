"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..functions.values import REGIONS, STATES
from .market import ENGLISH
from .queries import CENTRES, SEED

_BASE = f"""
WITH tr AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ENGLISH.items())}) AS t(cat, english)),
ship AS (SELECT l_orderkey AS order_id, max(l_shipdate) AS came FROM lineitem GROUP BY 1),
item AS (SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price, l_returnflag AS kind,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) AS freight_value,
  CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) * (1 + CAST(l_tax AS DECIMAL(12,2))) AS paid FROM lineitem),
pay AS (SELECT order_id, CAST(sum(paid) AS DOUBLE) AS total_payment_value, max(order_item_id) AS payment_installments FROM item GROUP BY 1),
kind AS (SELECT order_id, kind AS main_payment_type FROM (SELECT order_id, kind, row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, kind) AS r FROM item GROUP BY order_id, kind) WHERE r = 1),
cust AS (SELECT c_custkey AS customer_unique_id, c_mktsegment AS customer_city, n_name AS customer_state, r_name AS region FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey),
oe AS (SELECT o_orderkey AS order_id, customer_unique_id, o_orderstatus AS order_status, customer_city, customer_state AS customer_state_name, region,
  coalesce(total_payment_value, 0.0) AS total_payment_value, coalesce(main_payment_type, 'not_defined') AS main_payment_type, coalesce(payment_installments, 1) AS payment_installments,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS review_score, o_orderdate AS bought,
  CAST(floor(date_diff('microsecond', o_orderdate, came) / 86400000000.0) AS BIGINT) AS delivery_days,
  CAST(floor(date_diff('microsecond', o_orderdate + INTERVAL 30 DAY, came) / 86400000000.0) AS BIGINT) AS delivery_delay_days,
  hour(o_orderdate) AS order_hour, dayname(o_orderdate) AS order_day, strftime(o_orderdate, '%Y-%m') AS order_year_month
  FROM orders LEFT JOIN ship ON ship.order_id = o_orderkey LEFT JOIN cust ON customer_unique_id = o_custkey LEFT JOIN pay ON pay.order_id = o_orderkey LEFT JOIN kind ON kind.order_id = o_orderkey),
o AS (SELECT *, coalesce(delivery_delay_days > 0, false) AS is_late_delivery FROM oe),
fence AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM item),
ie AS (SELECT item.*, coalesce(p_type, NULL) AS product_category_name, CASE WHEN p_partkey IS NULL THEN NULL ELSE coalesce(english, 'Unknown') END AS product_category_name_english, n_name AS seller_state_name,
  (price < q1 - 1.5 * (q3 - q1)) OR (price > q3 + 1.5 * (q3 - q1)) AS is_price_outlier
  FROM item CROSS JOIN fence LEFT JOIN part ON p_partkey = product_id LEFT JOIN tr ON cat = p_type LEFT JOIN supplier ON s_suppkey = seller_id LEFT JOIN nation ON n_nationkey = s_nationkey),
rev AS (SELECT order_id AS review_id, CAST(review_score AS INTEGER) AS review_score, delivery_delay_days, is_late_delivery, customer_state_name, region,
  CASE WHEN delivery_delay_days > -100 AND delivery_delay_days <= 0 THEN 'Early/On-time' WHEN delivery_delay_days > 0 AND delivery_delay_days <= 5 THEN '0-5 days late'
    WHEN delivery_delay_days > 5 AND delivery_delay_days <= 15 THEN '5-15 days late' WHEN delivery_delay_days > 15 AND delivery_delay_days <= 100 THEN '15+ days late' END AS delay_bucket FROM o),
ce AS (SELECT o.customer_unique_id, count(DISTINCT order_id) AS order_count, coalesce(sum(total_payment_value), 0.0) AS total_spend, min(bought) AS first_order_at, max(bought) AS last_order_at, avg(review_score) AS avg_review_score,
  count(DISTINCT order_id) > 1 AS is_repeat_customer FROM o WHERE o.customer_unique_id IS NOT NULL GROUP BY 1),
late AS (SELECT seller_id, count(order_id) AS order_count, avg(CAST(is_late_delivery AS DOUBLE)) AS late_delivery_rate FROM (SELECT DISTINCT order_id, seller_id FROM item) LEFT JOIN (SELECT order_id, is_late_delivery FROM o) USING (order_id) GROUP BY 1),
se AS (SELECT late.*, item_count, item_revenue FROM late JOIN (SELECT seller_id, count(product_id) AS item_count, sum(price) AS item_revenue FROM item GROUP BY 1) USING (seller_id)),
rfm AS (SELECT customer_unique_id, CAST(floor(date_diff('microsecond', max(bought), (SELECT max(bought) + INTERVAL 1 DAY FROM o)) / 86400000000.0) AS BIGINT) AS Recency, count(DISTINCT order_id) AS Frequency, coalesce(sum(total_payment_value), 0.0) AS Monetary FROM o WHERE customer_unique_id IS NOT NULL GROUP BY 1),
z AS (SELECT customer_unique_id, (Recency - avg(Recency) OVER ()) / stddev_pop(Recency) OVER () AS Recency, (Frequency - avg(Frequency) OVER ()) / stddev_pop(Frequency) OVER () AS Frequency, (Monetary - avg(Monetary) OVER ()) / stddev_pop(Monetary) OVER () AS Monetary FROM rfm)
"""
_GAPS = ", ".join("(" + " + ".join(f"({c} - ({v})) * ({c} - ({v}))" for c, v in zip(("Recency", "Frequency", "Monetary"), x, strict=True)) + ")" for x in CENTRES)
_CLUSTERED = f", near AS (SELECT customer_unique_id, CAST(list_position(g, list_min(g)) - 1 AS INTEGER) AS Cluster FROM (SELECT customer_unique_id, [{_GAPS}] AS g FROM z))"
_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_HASH = f"substr(sha256({_NORM}), 1, 16)"
_TEXTS = f"""
WITH texts AS (SELECT doc_id AS review_id, text, quality AS label, {_NORM} AS norm, {_HASH} AS text_hash, source, n_chars FROM documents JOIN labels USING (doc_id)),
pred AS (SELECT label AS y, (n_chars % 997) / 997.0::DOUBLE AS score, CAST((n_chars % 997) / 997.0::DOUBLE >= 0.5 AS INTEGER) AS guess FROM texts),
conf AS (SELECT CAST(count_if(y = 0 AND guess = 0) AS DOUBLE) AS tn, CAST(count_if(y = 0 AND guess = 1) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND guess = 0) AS DOUBLE) AS fn, CAST(count_if(y = 1 AND guess = 1) AS DOUBLE) AS tp FROM pred)
"""
_ODD = f"""
WITH odd AS (SELECT doc_id AS review_id, CAST(substr(source, 4) AS INTEGER) % 2 AS label, {_NORM} AS norm, {_HASH} AS text_hash FROM documents),
bad AS (SELECT norm, count(DISTINCT label) AS labels, count(*) AS n FROM odd GROUP BY 1 HAVING count(DISTINCT label) > 1)
"""
_TOKENS = r"""
WITH tok AS (SELECT doc_id, token, i FROM (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents))),
freq AS (SELECT token, count(*) AS n FROM tok GROUP BY 1),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM freq QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 29998)
"""
_RANKS = """
, wide AS (SELECT o.order_id, review_score, CAST(delivery_days AS DOUBLE) AS delivery_days, CAST(delivery_delay_days AS DOUBLE) AS delivery_delay_days, total_payment_value, price, freight_value
  FROM o JOIN (SELECT order_id, avg(price) AS price, avg(freight_value) AS freight_value FROM item GROUP BY 1) USING (order_id)),
long AS (UNPIVOT wide ON review_score, delivery_days, delivery_delay_days, total_payment_value, price, freight_value INTO NAME c VALUE v),
pairs AS (SELECT a.c AS x, b.c AS y, a.order_id, a.v AS xv, b.v AS yv FROM long a JOIN long b ON a.order_id = b.order_id WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
ranked AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY xv) + (count(*) OVER (PARTITION BY x, y, xv) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY x, y ORDER BY yv) + (count(*) OVER (PARTITION BY x, y, yv) - 1) / 2.0 AS ry FROM pairs)
"""
_SPLIT = """
, drawn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST({key} AS VARCHAR) || '|{seed}'), {key}) AS r, count(*) OVER (PARTITION BY label) AS size FROM {source}),
cut AS (SELECT *, ceil(size * 0.2) AS t FROM drawn),
split AS (SELECT *, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((size - t) * 0.125) THEN 'val' ELSE 'train' END AS split FROM cut)
"""


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def _overlap(column: str) -> str:
    seen = lambda s: f"max(CAST(split = '{s}' AS INTEGER))"
    return f"""SELECT CAST(count_if(a = 1 AND b = 1) AS BIGINT) AS train_val, CAST(count_if(a = 1 AND c = 1) AS BIGINT) AS train_test, CAST(count_if(b = 1 AND c = 1) AS BIGINT) AS val_test,
  CAST(sum(na) AS BIGINT) AS n_train, CAST(sum(nb) AS BIGINT) AS n_val, CAST(sum(nc) AS BIGINT) AS n_test, '{"normalized_text" if column == "norm" else column}' AS compared
FROM (SELECT {column}, {seen("train")} AS a, {seen("val")} AS b, {seen("test")} AS c, count_if(split = 'train') AS na, count_if(split = 'val') AS nb, count_if(split = 'test') AS nc FROM split GROUP BY 1)"""


_LINE = lambda name, hit, wrong, lost: f"SELECT '{name}' AS class, {_ratio(hit, f'{hit} + {wrong}')} AS precision, {_ratio(hit, f'{hit} + {lost}')} AS recall, {_ratio(f'2 * {hit}', f'2 * {hit} + {wrong} + {lost}')} AS f1, CAST({hit} + {lost} AS BIGINT) AS support FROM conf"
_DESCRIBE = lambda c: f"SELECT is_price_outlier, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM ie GROUP BY 1"

ORACLES: dict[str, str] = {
    "monthly_revenue": _BASE + "SELECT order_year_month, round(coalesce(sum(total_payment_value), 0.0), 6) AS revenue FROM o WHERE order_status = 'F' GROUP BY 1",
    "orders_enriched": _BASE + "SELECT order_id, customer_unique_id, order_status, customer_city, customer_state_name, region, round(total_payment_value, 6) AS total_payment_value, main_payment_type, payment_installments, review_score, delivery_days, delivery_delay_days, is_late_delivery, CAST(order_hour AS INTEGER) AS order_hour, order_day, order_year_month FROM o",
    "order_items_enriched": _BASE + "SELECT order_id, order_item_id, product_id, seller_id, round(price, 6) AS price, round(freight_value, 6) AS freight_value, product_category_name, product_category_name_english, seller_state_name, is_price_outlier FROM ie",
    "reviews_enriched_bucket": _BASE + "SELECT * FROM rev",
    "customers_enriched": _BASE + "SELECT ce.customer_unique_id, order_count, round(total_spend, 6) AS total_spend, first_order_at, last_order_at, round(avg_review_score, 6) AS avg_review_score, is_repeat_customer, customer_city, customer_state FROM ce LEFT JOIN cust USING (customer_unique_id)",
    "sellers_enriched": _BASE + "SELECT seller_id, order_count, round(late_delivery_rate, 6) AS late_delivery_rate, item_count, round(item_revenue, 6) AS item_revenue FROM se",
    "legacy_merged_inflation": _BASE + "SELECT count(*) AS item_rows, count(DISTINCT order_id) AS orders, round(sum(total_payment_value), 3) AS inflated_revenue, CAST(count_if(is_late_delivery) AS BIGINT) AS late_rows FROM o JOIN item USING (order_id)",
    "payment_type_mode": _BASE + "SELECT order_id, main_payment_type FROM kind",
    "payment_totals": _BASE + "SELECT order_id, round(total_payment_value, 6) AS total_payment_value FROM pay",
    "installments_max": _BASE + "SELECT order_id, payment_installments FROM pay",
    "review_mean": "SELECT o_orderkey AS order_id, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS review_score FROM orders GROUP BY 1",
    "geo_compress": "SELECT user_id, round(avg(value), 6) AS value, first(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY 1",
    "order_status_distribution": "SELECT o_orderstatus AS order_status, count(*) AS order_count FROM orders GROUP BY 1",
    "payment_method_distribution": _BASE + "SELECT main_payment_type, count(*) AS order_count FROM o GROUP BY 1",
    "installment_distribution": _BASE + "SELECT payment_installments, count(*) AS order_count FROM o GROUP BY 1",
    "review_score_distribution": _BASE + "SELECT review_score, count(*) AS order_count, CAST(CAST(review_score AS INTEGER) AS VARCHAR) || ' Stars' AS stars FROM o GROUP BY 1",
    "monthly_orders": "SELECT strftime(o_orderdate, '%Y-%m') AS order_year_month, count(DISTINCT o_orderkey) AS order_count FROM orders GROUP BY 1",
    "top_cities": _BASE + "SELECT customer_city, count(DISTINCT order_id) AS order_count FROM o WHERE customer_city IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "top_categories_revenue": _BASE + "SELECT product_category_name_english, round(sum(price), 6) AS revenue FROM ie WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 4",
    "top_failed_categories": _BASE + "SELECT product_category_name_english, count(DISTINCT order_id) AS failed_orders FROM ie WHERE product_category_name_english IS NOT NULL AND order_id IN (SELECT order_id FROM o WHERE order_status IN ('P')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4",
    "peak_heatmap": "SELECT CAST(d.n AS INTEGER) AS day_number, d.day AS order_day, " + ", ".join(f"nullif(count(DISTINCT event_id) FILTER (WHERE hour(ts) = {h}), 0) AS h{h}" for h in range(24)) + " FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) AS d(n, day) LEFT JOIN events ON dayname(ts) = d.day GROUP BY 1, 2",
    "delivery_summary": _BASE + "SELECT round(avg(CAST(is_late_delivery AS DOUBLE)), 6) AS late_delivery_rate, count(delivery_days) AS n_delivered, round(avg(delivery_days), 6) AS avg_delivery_days FROM o",
    "late_rate_by_state": _BASE + "SELECT customer_state_name, CAST(count_if(is_late_delivery) AS BIGINT) AS late, CAST(count_if(NOT is_late_delivery) AS BIGINT) AS on_time, round(100.0 * count_if(is_late_delivery)::DOUBLE / count(*)::DOUBLE, 6) AS late_pct FROM o WHERE delivery_delay_days IS NOT NULL AND customer_state_name IS NOT NULL GROUP BY 1 ORDER BY 100.0 * count_if(is_late_delivery)::DOUBLE / count(*)::DOUBLE DESC, 1 LIMIT 15",
    "seller_late_ranking": _BASE + "SELECT seller_id, order_count, round(late_delivery_rate, 6) AS late_delivery_rate, item_count, round(item_revenue, 6) AS item_revenue FROM se ORDER BY se.late_delivery_rate DESC NULLS LAST, seller_id LIMIT 10",
    "review_by_delay_bucket": _BASE + "SELECT delay_bucket, round(avg(review_score), 6) AS mean_score, round(median(review_score), 6) AS median_score, round(stddev_samp(review_score), 6) AS std_score, count(review_score) AS n FROM rev WHERE delay_bucket IS NOT NULL GROUP BY 1",
    "price_describe_by_outlier": _BASE + _DESCRIBE("price") + " UNION ALL " + _DESCRIBE("freight_value"),
    "business_summary": _BASE + """SELECT count(DISTINCT order_id) AS total_unique_orders, (SELECT count(*) FROM ce) AS total_unique_customers, (SELECT count(*) FROM se) AS total_unique_sellers,
  round(coalesce(sum(total_payment_value) FILTER (WHERE order_status = 'F'), 0.0), 4) AS total_order_payment_revenue_delivered, (SELECT round(sum(price), 4) FROM item) AS total_item_revenue, round(avg(nullif(review_score, 0)), 4) AS avg_review_score,
  round(avg(CAST(is_late_delivery AS DOUBLE)) * 100, 4) AS late_delivery_rate_pct, (SELECT round(avg(CAST(is_repeat_customer AS DOUBLE)) * 100, 4) FROM ce) AS repeat_customer_rate_pct,
  (SELECT string_agg(order_status || '=' || n, ',' ORDER BY order_status) FROM (SELECT order_status, count(*) AS n FROM o GROUP BY 1)) AS order_status_distribution FROM o""",
    "customer_summary": _BASE + "SELECT count(DISTINCT customer_unique_id) AS total_customers, round_even(avg(CAST(is_repeat_customer AS DOUBLE)) * 100, 2) AS repeat_customer_pct, round_even(avg(order_count), 3) AS avg_orders_per_customer, round_even(avg(total_spend), 2) AS avg_spend_per_customer FROM ce",
    "seller_summary": _BASE + "SELECT count(DISTINCT seller_id) AS total_sellers, round_even(avg(late_delivery_rate) * 100, 2) AS avg_late_delivery_rate_pct, round_even(avg(item_revenue), 2) AS avg_item_revenue FROM se",
    "repeat_purchase_rate": _BASE + "SELECT round(avg(CAST(is_repeat_customer AS DOUBLE)) * 100, 6) AS repeat_customer_pct, round(100 - avg(CAST(is_repeat_customer AS DOUBLE)) * 100, 6) AS one_time_customer_pct, count(*) AS n_customers FROM ce",
    "customer_order_count": "SELECT o_orderkey AS order_id, o_custkey // 10 AS customer_unique_id, n AS customer_order_count FROM orders JOIN (SELECT o_custkey // 10 AS p, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) ON p = o_custkey // 10",
    "seller_late_rate_items": _BASE + "SELECT item.order_id, order_item_id, product_id, seller_id, round(late_delivery_rate, 6) AS seller_late_delivery_rate FROM item LEFT JOIN late USING (seller_id)",
    "join_cardinality": "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS left_duplicate_keys, (SELECT count(*) FROM lineitem) AS right_rows, (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem) AS right_duplicate_keys, 'one-to-many' AS relationship",
    "rfm_table": _BASE + "SELECT customer_unique_id, Recency, Frequency, round(Monetary, 6) AS Monetary FROM rfm",
    "rfm_scaled": _BASE + "SELECT customer_unique_id, round(Recency, 6) AS Recency, round(Frequency, 6) AS Frequency, round(Monetary, 6) AS Monetary FROM z",
    "rfm_nearest_centroid": _BASE + _CLUSTERED + "SELECT * FROM near",
    "rfm_segment_labels": _BASE + _CLUSTERED + """, named AS (SELECT Cluster, ['Champion', 'Loyal Customer', 'Potential Loyal', 'At Risk'][row_number() OVER (ORDER BY avg(Monetary) DESC, Cluster)] AS Segment FROM rfm JOIN near USING (customer_unique_id) GROUP BY 1)
SELECT Segment, round_even(avg(Recency), 2) AS Recency, round_even(avg(Frequency), 2) AS Frequency, round_even(avg(Monetary), 2) AS Monetary, count(*) AS customer_count FROM rfm JOIN near USING (customer_unique_id) JOIN named USING (Cluster) GROUP BY 1""",
    "spearman_corr": _BASE + _RANKS + "SELECT x, y, round(corr(rx, ry), 9) AS spearman FROM ranked GROUP BY 1, 2",
    "late_significance": _BASE + """, kept AS (SELECT review_score AS v, is_late_delivery AS f FROM o WHERE delivery_delay_days IS NOT NULL AND review_score IS NOT NULL),
ranks AS (SELECT v, f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM kept),
s AS (SELECT count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, avg(v) FILTER (WHERE f) AS m1, avg(v) FILTER (WHERE NOT f) AS m2, median(v) FILTER (WHERE f) AS d1, median(v) FILTER (WHERE NOT f) AS d2,
  stddev_samp(v) FILTER (WHERE f) AS s1, stddev_samp(v) FILTER (WHERE NOT f) AS s2, sum(r) FILTER (WHERE f) AS rs FROM ranks)
SELECT n1 AS n_late, round(m1, 8) AS mean_late, round(d1, 8) AS median_late, round(s1, 8) AS std_late, n2 AS n_on_time, round(m2, 8) AS mean_on_time, round(d2, 8) AS median_on_time, round(s2, 8) AS std_on_time,
  round((m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2), 8) AS welch_t, CAST(rs - n1 * (n1 + 1) / 2 AS DOUBLE) AS mann_whitney_u, (SELECT CAST(sum(t * t * t - t) AS DOUBLE) FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM kept GROUP BY v)) AS tie_sum, round((m2 - m1) / sqrt((s1 * s1 + s2 * s2) / 2), 8) AS cohens_d FROM s""",
    "text_normalize_hash": f"SELECT doc_id, CAST(length({_NORM}) AS BIGINT) AS normalized_length, {_HASH} AS text_hash FROM documents",
    "token_counts": _TOKENS + "SELECT token, n FROM freq",
    "vocab_topk": _TOKENS + "SELECT token, n, id FROM vocab",
    "token_ids_padded": _TOKENS + ", ids AS (SELECT doc_id, i, coalesce(id, 1) AS id FROM tok LEFT JOIN vocab USING (token) WHERE i <= 100) SELECT documents.doc_id, array_to_string((coalesce(any_value(l), []) || [0 FOR x IN range(100)])[1:100], ' ') AS ids FROM documents LEFT JOIN (SELECT doc_id, list(id ORDER BY i) AS l FROM ids GROUP BY 1) USING (doc_id) GROUP BY documents.doc_id",
    "negation_flag": r"SELECT doc_id, regexp_matches(text, '(?i)\b(not|no|never|n''t|cannot|nothing|nobody|nowhere|neither|nor|without|hardly|barely|scarcely)\b') AS is_negated FROM documents",
    "negation_balanced_sample": _TEXTS
    + rf""", f AS (SELECT review_id, label, regexp_matches(text, '(?i)\b(not|no|never|n''t|cannot|nothing|nobody|nowhere|neither|nor|without|hardly|barely|scarcely)\b') AS is_negated FROM texts),
q AS (SELECT is_negated, least(CASE WHEN is_negated THEN 60 ELSE 40 END, count_if(label = 0)) AS quota FROM f GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY is_negated, label ORDER BY sha256(CAST(review_id AS VARCHAR) || '|{SEED}'), review_id) AS r FROM f)
SELECT review_id, label, is_negated FROM r JOIN q USING (is_negated) WHERE r.r <= quota""",
    "sentiment_labels": f"SELECT doc_id AS review_id, CASE WHEN n_chars % 6 IN (1, 2) THEN 0 ELSE 1 END AS label, {_HASH} AS text_hash FROM documents WHERE n_chars % 6 IN (1, 2, 4, 5) AND text <> 'No Message' AND NOT regexp_full_match(text, '\\s*')",
    "conflicting_labels": _ODD + "SELECT substr(sha256(norm), 1, 16) AS text_hash, labels, n FROM bad",
    "dedupe_text": _ODD + "SELECT review_id, label, text_hash FROM odd WHERE norm NOT IN (SELECT norm FROM bad) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY review_id) = 1",
    "dedupe_report": _ODD + "SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(count_if(l = 1) AS BIGINT) AS rows_after, CAST(count_if(l = 1 AND n > 1) AS BIGINT) AS duplicate_groups, CAST(count_if(l > 1) AS BIGINT) AS conflicting_label_groups, CAST(coalesce(sum(n) FILTER (WHERE l > 1), 0) AS BIGINT) AS conflicting_label_rows_dropped FROM (SELECT norm, count(*) AS n, count(DISTINCT label) AS l FROM odd GROUP BY 1)",
    "stratified_split": _TEXTS + ", one AS (SELECT * FROM texts WHERE norm NOT IN (SELECT norm FROM texts GROUP BY 1 HAVING count(DISTINCT label) > 1) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY review_id) = 1)" + _SPLIT.format(key="text_hash", seed=SEED, source="one") + "SELECT review_id, label, split FROM split",
    "split_overlap": _TEXTS + _SPLIT.format(key="review_id", seed=SEED, source="texts") + " UNION ALL ".join(_overlap(c) for c in ("review_id", "norm", "source")),
    "class_weights": _TEXTS + "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM texts GROUP BY 1",
    "confusion_metrics": _TEXTS
    + f"""SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, round({_ratio("tn + tp", "tn + fp + fn + tp")}, 9) AS accuracy,
  round(({_ratio("tp", "tp + fp")} + {_ratio("tn", "tn + fn")}) / 2, 9) AS macro_precision, round(({_ratio("tp", "tp + fn")} + {_ratio("tn", "tn + fp")}) / 2, 9) AS macro_recall,
  round(({_ratio("2 * tp", "2 * tp + fp + fn")} + {_ratio("2 * tn", "2 * tn + fp + fn")}) / 2, 9) AS macro_f1, round({_ratio("tp * tn - fp * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)")}, 9) AS mcc FROM conf""",
    "class_report": _TEXTS
    + f""", r AS ({_LINE("0", "tn", "fn", "fp")} UNION ALL {_LINE("1", "tp", "fp", "fn")}), w AS (SELECT *, support / sum(support) OVER () AS share FROM r)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * share), 9), round(sum(recall * share), 9), round(sum(f1 * share), 9), CAST(sum(support) AS BIGINT) FROM w""",
    "roc_auc": _TEXTS + "SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9) AS roc_auc FROM pred p, pred n WHERE p.y = 1 AND n.y = 0",
    "average_precision": _TEXTS + """, s AS (SELECT score, sum(y) AS pos, count(*) AS n FROM pred GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM s)
SELECT round(sum(pos * (tp / k)) / sum(pos), 9) AS average_precision FROM c""",
    "exact_duplicates": "SELECT 'lineitem' AS \"table\", CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) UNION ALL SELECT 'texts', CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
    "missing_values": _BASE + "SELECT 'orders_enriched' AS \"table\", c AS \"column\", n AS missing FROM (SELECT 'order_delivered_customer_date' AS c, CAST(count_if(delivery_days IS NULL) AS BIGINT) AS n FROM o UNION ALL SELECT 'delivery_days', CAST(count_if(delivery_days IS NULL) AS BIGINT) FROM o UNION ALL SELECT 'delivery_delay_days', CAST(count_if(delivery_days IS NULL) AS BIGINT) FROM o) WHERE n > 0",
    "union_oversample": "SELECT lang, CAST(copy AS INTEGER) AS copy, count(*) AS n FROM (SELECT lang, unnest(range(1, CASE WHEN lang = 'fr' THEN 5 ELSE 2 END)) AS copy FROM documents UNION ALL SELECT lang, 0 FROM documents WHERE lang <> 'fr') GROUP BY 1, 2",
    "aspect_cross": "SELECT doc_id, aspect, CAST(length(text) AS INTEGER) AS n_chars FROM documents, (VALUES ('delivery'), ('product quality'), ('price'), ('customer service'), ('packaging')) AS a(aspect)",
    "event_props_json": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 6) AS total FROM events GROUP BY 1, 2",
    "array_encoding": r"WITH w AS (SELECT doc_id, [CASE t WHEN 'the' THEN 2 WHEN 'of' THEN 3 WHEN 'de' THEN 4 WHEN 'and' THEN 5 ELSE 1 END FOR t IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')] AS i FROM documents) SELECT doc_id, array_to_string((i || [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ' ') AS post, array_to_string(([0, 0, 0, 0, 0, 0, 0, 0] || i)[len(i) + 1 : len(i) + 8], ' ') AS pre FROM w",
    "average_ranks": "SELECT n_chars, CAST(min(r) + (count(*) - 1) / 2.0 AS DOUBLE) AS rank, count(*) AS ties FROM (SELECT n_chars, rank() OVER (ORDER BY n_chars) AS r FROM documents) GROUP BY 1",
    "negation_accuracy": r"SELECT round(avg(CASE WHEN regexp_matches(text, '(?i)\b(not|no|never|n''t|cannot|nothing|nobody|nowhere|neither|nor|without|hardly|barely|scarcely)\b') = (lang = 'en') THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM documents",
    "keep_first_rank": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first_day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
}

_STATES = "(VALUES " + ", ".join(f"({n}, '{c}', '{name}', '{REGIONS[c]}')" for n, (c, name) in enumerate(STATES.items())) + ") AS s(n, code, name, region)"
_WHOLE = "SELECT '{0}' AS \"column\", CASE WHEN min({0}) >= -128 AND max({0}) <= 127 THEN 'tinyint' WHEN min({0}) >= -32768 AND max({0}) <= 32767 THEN 'smallint' WHEN min({0}) >= -2147483648 AND max({0}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM lineitem"
_REAL = "SELECT '{0}', CASE WHEN bool_and(CAST(CAST({0} AS FLOAT) AS DOUBLE) = {0}) THEN 'float' ELSE 'double' END FROM lineitem"
_HALF = "WITH h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'No Message' WHEN doc_id % 11 <> 0 THEN text END AS message, CASE WHEN doc_id % 2 = 0 THEN lang END AS done FROM documents) "
_ONE = ", one AS (SELECT * FROM texts WHERE norm NOT IN (SELECT norm FROM texts GROUP BY 1 HAVING count(DISTINCT label) > 1) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY review_id) = 1)"
ORACLES |= {
    "pruned_scan": "SELECT o_orderkey, o_orderstatus FROM orders",
    "product_imputation": "SELECT p_partkey AS product_id, CASE WHEN p_size % 3 <> 0 THEN p_type ELSE 'unknown' END AS product_category_name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.0::DOUBLE END AS product_weight_g FROM part",
    "review_imputation": "SELECT doc_id AS review_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'No Title' END AS review_comment_title, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE 'No Message' END) AS message_md5 FROM documents",
    "type_correction": "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS purchased FROM orders",
    "narrowed_types": " UNION ALL ".join([_WHOLE.format("l_orderkey"), _WHOLE.format("l_linenumber"), _REAL.format("l_quantity"), _REAL.format("l_discount")]),
    "state_regions": f"SELECT c_custkey, coalesce(name, 'XX') AS state, region, region AS region_of_name FROM customer LEFT JOIN {_STATES} ON c_custkey % {len(STATES) + 1} = n",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "class_probabilities": """WITH x AS (SELECT doc_id, (n_chars % 97 - 48) / 10.0::DOUBLE AS x FROM documents), e AS (SELECT *, exp(x) AS a, exp(-x) AS b, exp(0.5::DOUBLE) AS c FROM x)
SELECT doc_id, round(1 / (1 + b), 9) AS sigmoid, round(a / (a + b + c), 9) AS soft, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS best, round(CASE WHEN doc_id % 2 = 1 THEN 0.975::DOUBLE ELSE 0.025::DOUBLE END, 9) AS smooth FROM e""",
    "strongest_values": "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS token, CAST(CASE WHEN l_linenumber % 2 = 1 THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, CAST(l_linenumber AS VARCHAR)) <= 2",
    "formatted_money": r"SELECT o_orderkey, 'R$' || format('{:,.2f}', o_totalprice) AS money, regexp_replace(format('{:,.3f}', o_totalprice), '\.?0+$', '') AS grouped FROM orders",
    "rows_to_translate": _HALF + r"SELECT doc_id FROM h WHERE message IS DISTINCT FROM 'No Message' AND (done IS NULL OR regexp_full_match(done, '\s*'))",
    "translation_manifest": _HALF + r"SELECT count(*) AS total_rows, CAST(count_if(done IS NOT NULL AND NOT regexp_full_match(done, '\s*')) AS BIGINT) AS translated_rows, CAST(count_if(message IS DISTINCT FROM 'No Message' AND (done IS NULL OR regexp_full_match(done, '\s*'))) AS BIGINT) AS failed_rows FROM h",
    "fake_tallies": "SELECT count(*) AS n_scored, CAST(count_if(n_chars % 5 = 0) AS BIGINT) AS n_failed, CAST(count_if(n_chars % 5 <> 0 AND n_chars % 3 = 0) AS BIGINT) AS n_flagged_fake FROM documents",
    "vocab_bounds": _TOKENS + "SELECT count(*) + 1 AS vocab_size, CAST(coalesce(max(id), 1) AS BIGINT) AS max_index FROM vocab",
    "text_batches": _TOKENS + ", ids AS (SELECT doc_id, i, coalesce(id, 1) AS id FROM tok LEFT JOIN vocab USING (token) WHERE i <= 100) SELECT documents.doc_id, CAST(documents.doc_id % 2 AS INTEGER) AS label, CAST(coalesce(len(any_value(l)), 0) AS INTEGER) AS n_ids, coalesce(array_to_string(any_value(l), ' '), '') AS ids FROM documents LEFT JOIN (SELECT doc_id, list(id ORDER BY i) AS l FROM ids GROUP BY 1) USING (doc_id) GROUP BY documents.doc_id",
    "manifest_texts": _TEXTS + _ONE + _SPLIT.format(key="text_hash", seed=SEED, source="one") + "SELECT review_id, split, md5(smallest) AS text_md5 FROM split LEFT JOIN (SELECT text_hash, min(text) AS smallest FROM texts GROUP BY 1) USING (text_hash)",
    "token_shapley": """
WITH w AS (SELECT p_partkey, regexp_extract_all(lower(concat_ws(' ', p_name, p_type, p_brand)), '[\\p{L}\\p{N}_]+') AS l FROM part),
word AS (SELECT p_partkey, l, unnest(range(len(l))) AS place FROM w)
SELECT p_partkey, CAST(place AS INTEGER) AS place, l[place + 1] AS token, round((length(l[place + 1]) - 5) / 10 + (len([x FOR x IN l IF x[1] = l[place + 1][1]]) - 1) / 4, 6) AS value FROM word
""",
    "first_training_step": _TEXTS + r"""
, heavy AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM texts WHERE label IS NOT NULL GROUP BY 1),
example AS (SELECT row_number() OVER () AS r, label, w, w * (0.5 - label) AS wrong, regexp_extract_all(norm, '[\p{L}\p{N}_]+') AS l FROM texts JOIN heavy USING (label)),
used AS (SELECT r, wrong, unnest(l) AS token FROM example),
vocab AS (SELECT token FROM used GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 30000),
g AS (SELECT token, sum(wrong) / (SELECT sum(w) FROM example) AS g FROM used SEMI JOIN vocab USING (token) GROUP BY 1 UNION ALL SELECT NULL, sum(wrong) / sum(w) FROM example),
small AS (SELECT least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS cut FROM g)
SELECT token, round(g, 6) + 0.0 AS gradient, round(-0.05 * (g * cut) / (abs(g * cut) + 1e-8), 6) + 0.0 AS weight FROM g, small
""",
    "segment_lookup": f"SELECT * FROM ({ORACLES['rfm_segment_labels']}) WHERE lower(Segment) = 'at risk'",
}
#: Tails by Simpson's rule over 4,000 steps, of the normal density and of Student's after t = sqrt(f) * tan(a).
ORACLES["late_p_values"] = f"""
WITH two AS ({ORACLES["late_significance"]}),
x AS (SELECT *, pow(std_late, 2) / n_late AS a, pow(std_on_time, 2) / n_on_time AS b, n_late * n_on_time AS nn, CAST(n_late + n_on_time AS DOUBLE) AS n FROM two),
y AS (SELECT *, pow(a + b, 2) / (a * a / (n_late - 1) + b * b / (n_on_time - 1)) AS f, greatest(greatest(mann_whitney_u, nn - mann_whitney_u) - nn / 2 - 0.5, 0) / sqrt(nn / 12 * (n + 1 - tie_sum / (n * (n - 1)))) AS z FROM x),
w AS (SELECT *, atan(abs(welch_t) / sqrt(f)) AS top FROM y),
k AS (SELECT unnest(range(4001)) AS k),
sums AS (SELECT sum(c * exp((f - 1) * ln(cos(top * k / 4000)))) * any_value(top) / 12000 AS student, sum(c * exp(-pow(z * k / 4000, 2) / 2)) * any_value(z) / 12000 AS normal
  FROM w, (SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM k)),
p AS (SELECT round(welch_t, 6) AS welch_t, round(greatest(0, 1 - student / (sqrt(pi()) / 2 * exp(lgamma(f / 2) - lgamma((f + 1) / 2)))), 6) AS welch_p, round(mann_whitney_u, 6) AS mann_whitney_u,
  round(least(1, greatest(0, 1 - 2 * normal / sqrt(2 * pi()))), 6) AS mann_whitney_p, round(cohens_d, 6) AS cohens_d FROM w, sums)
SELECT *, mann_whitney_p < 0.05 AS significant FROM p
"""
