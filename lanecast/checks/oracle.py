"""DuckDB SQL for every report, over the raw TPC-H-like tables.

Written apart from the Spark operators: it works on whole rows (no counted
values, no cells), takes origins and latest reviews from window ranks, finds
bands by a range join, and computes variances directly.  Doubles are rounded to
six places on both sides.
"""

from __future__ import annotations

import re

# Named subqueries; a report's SQL pulls in those it mentions, in this order.
PARTS = {
    "timeline": """
        SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderstatus AS st, o.o_orderdate AS d0,
               CAST(COALESCE(s.s_nationkey, 0) AS BIGINT) AS sn, CAST(c.c_nationkey AS BIGINT) AS cn,
               o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400) AS bought
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, MAX(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) l
               ON l.l_orderkey = o.o_orderkey
        LEFT JOIN supplier s ON s.s_suppkey = l.sk
        LEFT JOIN customer c ON c.c_custkey = o.o_custkey""",
    "approvals": """
        SELECT *, bought + to_seconds(CASE WHEN k % 13 = 0 THEN (k * 104729) % 172800
                                           ELSE (k * 104729) % 7200 END) AS okayed
        FROM timeline""",
    "handoffs": """
        SELECT *, okayed + to_seconds(CASE WHEN k % 1009 = 0 THEN -(691200 + (k * 31) % 864000)
                                           WHEN k % 71 = 0 THEN -((k * 48611) % 259200)
                                           ELSE (k * 15485) % 518400 END) AS scanned
        FROM approvals""",
    "o_src": """
        SELECT k AS oid, ck AS cid, CASE st WHEN 'P' THEN 'shipped' ELSE 'delivered' END AS status,
               bought,
               CASE WHEN k % 211 <> 0 THEN okayed END AS okayed,
               CASE WHEN k % 307 <> 0 THEN scanned END AS scanned,
               CASE WHEN k % 401 <> 0 THEN scanned + to_seconds(
                   86400 * (2 + (sn + cn) % 9)
                   + (k * 32452) % (86400 * (1 + (sn * cn) % 17))
                   + CASE WHEN k % 19 = 0 THEN (k * 99991) % (86400 * 25) ELSE 0 END) END AS arrived,
               CASE WHEN k % 503 <> 0 THEN d0 + to_seconds(86400 * (12 + (sn + cn) % 9 + k % 5)) END AS due
        FROM handoffs""",
    "c_src": """
        SELECT c_custkey AS cid, c_custkey - c_custkey % 2 AS person,
               CASE WHEN c_custkey % 97 <> 0 THEN n_name END AS state,
               'CITY_' || (c_custkey % 50) AS city, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "s_src": """
        SELECT s_suppkey AS sid, n_name AS state,
               'CITY_' || (s_suppkey % 50) AS city, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "r_src": """
        SELECT oid, oid * 10 + r AS rid, due + to_seconds(86400 * CASE WHEN oid % 58 = 0 THEN 1 ELSE r END) AS written,
               CASE WHEN r = 1 AND oid % 143 = 0 THEN NULL
                    WHEN arrived > due THEN 1 + (oid * 31 + r) % 3 ELSE 3 + (oid * 17 + r) % 3 END AS stars
        FROM o_src, (VALUES (1), (2)) AS copies(r)
        WHERE r = 1 OR oid % 29 = 0""",
    "kept": """
        SELECT *, date_diff('day', bought, arrived) AS days, date_diff('day', due, arrived) AS err,
               arrived > due AS late, scanned < okayed AS odd,
               date_diff('hour', bought, okayed) AS h1, date_diff('hour', okayed, scanned) AS h2,
               date_diff('hour', scanned, arrived) AS h3
        FROM o_src
        WHERE status = 'delivered'
          AND bought >= TIMESTAMP '1995-07-01' AND bought < TIMESTAMP '2001-01-01'
          AND okayed IS NOT NULL AND scanned IS NOT NULL AND arrived IS NOT NULL
          AND date_diff('hour', scanned, okayed) <= 168""",
    "sold": """
        SELECT l_orderkey AS oid, l_suppkey AS sid, state, l_shipdate AS lim,
               dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS seller_no,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_suppkey) AS pick
        FROM lineitem LEFT JOIN s_src ON sid = l_suppkey""",
    "baskets": """
        SELECT oid, COUNT(*) AS items, MAX(seller_no) AS sellers, COUNT(DISTINCT state) AS states,
               MAX(CASE WHEN pick = 1 THEN sid END) AS origin, MAX(CASE WHEN pick = 1 THEN state END) AS ostate
        FROM sold GROUP BY oid""",
    "facts": """
        SELECT kept.*, CAST(bought AS DATE) AS day, origin, ostate, c.state AS dstate,
               ostate || ' -> ' || c.state AS lane, sellers, states
        FROM kept JOIN baskets USING (oid) LEFT JOIN c_src c ON c.cid = kept.cid""",
    "hist": "SELECT * FROM facts WHERE day < DATE '1999-07-01'",
    "by_lane": """
        SELECT lane, COUNT(*) AS n, quantile_cont(days, [0.90, 0.92, 0.95]) AS q
        FROM hist GROUP BY lane HAVING n >= 10""",
    "by_state": """
        SELECT dstate, COUNT(*) AS n, quantile_cont(days, [0.90, 0.92, 0.95]) AS q
        FROM hist GROUP BY dstate""",
    "overall": "SELECT quantile_cont(days, [0.90, 0.92, 0.95]) AS q FROM hist",
    "judged": """
        SELECT f.oid, f.lane, f.dstate, f.days, f.late, f.days - f.err AS now,
               CAST(ceil(t.q[1]) AS BIGINT) AS p90, CAST(ceil(t.q[2]) AS BIGINT) AS p92,
               CAST(ceil(t.q[3]) AS BIGINT) AS p95, t.tier
        FROM facts f
        JOIN LATERAL (
            SELECT q, '1_lane' AS tier FROM by_lane l WHERE l.lane = f.lane
            UNION ALL SELECT q, '2_state' FROM by_state s WHERE s.dstate = f.dstate
            UNION ALL SELECT q, '3_national' FROM overall
        ) t ON TRUE
        WHERE f.day >= DATE '1999-07-01'
        QUALIFY t.tier = MIN(t.tier) OVER (PARTITION BY f.oid)""",
    "service": """
        SELECT lane, COUNT(*) AS n, AVG(now) AS a_now, AVG(p95) AS a_95, AVG(now - p95) AS a_saved,
               100.0 * COUNT(*) FILTER (WHERE days <= now) / COUNT(now) AS s_now,
               100.0 * COUNT(*) FILTER (WHERE days <= p90) / COUNT(*) AS s_90,
               100.0 * COUNT(*) FILTER (WHERE days <= p95) / COUNT(*) AS s_95
        FROM judged WHERE tier = '1_lane' GROUP BY lane""",
    "results": """
        SELECT f.oid, c.person, f.day, f.days, f.err, f.late, r.stars, p.paid
        FROM facts f
        LEFT JOIN c_src c ON c.cid = f.cid
        LEFT JOIN (SELECT oid, stars, row_number() OVER (PARTITION BY oid ORDER BY written DESC NULLS LAST, rid DESC) AS k
                   FROM r_src) r ON r.oid = f.oid AND r.k = 1
        LEFT JOIN (SELECT l_orderkey,
                          SUM(CASE WHEN l_orderkey % 113 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS paid
                   FROM lineitem GROUP BY l_orderkey) p ON p.l_orderkey = f.oid""",
}

# Band label and the first and last whole day (or hour) it holds.
PROMISE = """(VALUES
    ('a) 20+ days early', -1000000, -20), ('b) 10-20 days early', -19, -10),
    ('c) 5-10 days early', -9, -5), ('d) 1-5 days early', -4, -1),
    ('e) exactly on time', 0, 0), ('f) 1-5 days late', 1, 5),
    ('g) 5+ days late', 6, 1000000)) AS bands(label, lo, hi)"""
GAPS = """(VALUES
    ('a) 0-6 hours', -1000000, 6), ('b) 6-24 hours', 7, 24), ('c) 1-3 days', 25, 72),
    ('d) 3-7 days', 73, 168), ('e) over 7 days', 169, 1000000)) AS bands(label, lo, hi)"""
REVIEW = """(VALUES
    ('a) 10+ days early', -1000000, -10), ('b) 1-9 days early', -9, -1),
    ('c) on time', 0, 0), ('d) 1-3 days late', 1, 3), ('e) 4-7 days late', 4, 7),
    ('f) 8-14 days late', 8, 14), ('g) 15+ days late', 15, 1000000)) AS bands(label, lo, hi)"""
REVIEW_CHART = """(VALUES
    ('a) 10+ early', -1000000, -10), ('b) 1-9 early', -9, -1), ('c) on time', 0, 0),
    ('d) 1-3 late', 1, 3), ('e) 4-7 late', 4, 7), ('f) 8-14 late', 8, 14),
    ('g) 15+ late', 15, 1000000)) AS bands(label, lo, hi)"""

# An order without a promise falls into the last band, which takes what is left.
_LAST = "COALESCE(err, 1000000)"
_LATE = "round(100.0 * COUNT(*) FILTER (WHERE late) / NULLIF(COUNT(late), 0), 6)"
_PLACE = f"""COUNT(*) AS n_orders, round(median(h3) / 24.0, 6) AS median_transit,
    round(quantile_cont(h3, 0.95) / 24.0, 6) AS p95_transit,
    round(median(err), 6) AS median_promise_error, {_LATE} AS pct_late"""
_QUANTILES = """CAST(ceil(q[1]) AS BIGINT) AS promise_90, CAST(ceil(q[2]) AS BIGINT) AS promise_92,
    CAST(ceil(q[3]) AS BIGINT) AS promise_95"""
_POLICY = """(SELECT policy, promise, days, now FROM judged,
    LATERAL (VALUES ('current', now), ('recal_p90', p90), ('recal_p92', p92), ('recal_p95', p95)) v(policy, promise))"""
_SPREAD = """(SELECT policy, s, n FROM service,
    LATERAL (VALUES ('current', s_now), ('recal_p90', s_90), ('recal_p95', s_95)) v(policy, s))"""


def _extremes(label: str, direction: str) -> str:
    return f"""(SELECT '{label}' AS grp, dstate AS customer_state, COUNT(*) AS n_orders,
        round(median(h3) / 24.0, 6) AS median_transit
        FROM trusted GROUP BY dstate HAVING n_orders >= 200
        ORDER BY median(h3) {direction}, dstate NULLS LAST LIMIT 5)"""


PARTS["trusted"] = """
        SELECT kept.*, c.state AS dstate FROM kept LEFT JOIN c_src c ON c.cid = kept.cid WHERE NOT odd"""

REPORTS = {
    "load_check": """
        SELECT COUNT(*) AS total_rows, COUNT(DISTINCT oid) AS unique_orders,
               MIN(bought) AS earliest_purchase, MAX(bought) AS latest_purchase FROM o_src""",
    "status_breakdown": """
        SELECT status AS order_status, COUNT(*) AS n_orders,
               round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM o_src), 6) AS pct FROM o_src GROUP BY status""",
    "timestamp_completeness": """
        SELECT COUNT(*) AS delivered_orders, COUNT(okayed) AS has_approved, COUNT(scanned) AS has_carrier,
               COUNT(arrived) AS has_customer, COUNT(due) AS has_estimate FROM o_src WHERE status = 'delivered'""",
    "ordering_violations": """
        SELECT CAST(COALESCE(SUM(CASE WHEN okayed < bought THEN 1 END), 0) AS BIGINT) AS approved_before_purchase,
               CAST(COALESCE(SUM(CASE WHEN scanned < okayed THEN 1 END), 0) AS BIGINT) AS shipped_before_approved,
               CAST(COALESCE(SUM(CASE WHEN arrived < scanned THEN 1 END), 0) AS BIGINT) AS delivered_before_shipped
        FROM o_src WHERE status = 'delivered'""",
    "monthly_volume": """
        SELECT strftime(bought, '%Y-%m') AS month, COUNT(*) AS n_orders
        FROM o_src GROUP BY 1""",
    "violation_gap_summary": """
        SELECT COUNT(*) AS n_orders, MIN(h) AS min_hours, round(median(h), 6) AS median_hours,
               round(quantile_cont(h, 0.95), 6) AS p95_hours, MAX(h) AS max_hours
        FROM (SELECT date_diff('hour', scanned, okayed) AS h FROM o_src
              WHERE scanned < okayed AND status = 'delivered')""",
    "violation_gap_buckets": f"""
        SELECT label AS gap_bucket, COUNT(*) AS n_orders
        FROM o_src JOIN {GAPS} ON date_diff('hour', scanned, okayed) BETWEEN lo AND hi
        WHERE scanned < okayed AND status = 'delivered' GROUP BY label""",
    "violation_vs_clean": """
        SELECT IF(scanned < okayed, 'violation', 'clean') AS grp, COUNT(*) AS n_orders,
               round(median(date_diff('day', bought, arrived)), 6) AS median_total_days,
               round(quantile_cont(date_diff('day', bought, arrived), 0.95), 6) AS p95_total_days
        FROM o_src
        WHERE status = 'delivered' AND okayed IS NOT NULL AND scanned IS NOT NULL AND arrived IS NOT NULL
        GROUP BY 1""",
    "category_mix": """
        SELECT COALESCE(en, raw, 'unknown') AS category, COUNT(*) AS items_sold,
               round(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_extendedprice), 6) AS avg_price_brl,
               round(AVG(p_size * 100) / 1000.0, 6) AS avg_weight_kg
        FROM lineitem
        LEFT JOIN (SELECT p_partkey, p_size, CASE WHEN p_partkey % 23 = 0 THEN NULL
                          WHEN p_partkey % 3 = 0 THEN lower(p_type)
                          ELSE lower(p_type) || '_' || (p_size % 5) END AS raw FROM part)
               ON p_partkey = l_partkey
        LEFT JOIN (SELECT unnest(['economy', 'promo', 'large', 'small']) AS word, word || '_en' AS en) ON word = raw
        GROUP BY 1 ORDER BY items_sold DESC, category LIMIT 15""",
    "orders_base": """
        SELECT oid AS order_id, cid AS customer_id, bought AS purchased_at, okayed AS approved_at,
               scanned AS shipped_at, arrived AS delivered_at, due AS promised_at, days AS total_days,
               err AS promise_error_days, late AS is_late, odd AS approval_suspect FROM kept""",
    "base_funnel": """
        SELECT 'all orders' AS stage, (SELECT COUNT(*) FROM o_src) AS n
        UNION ALL SELECT 'delivered', (SELECT COUNT(*) FROM o_src WHERE status = 'delivered')
        UNION ALL SELECT 'final base', (SELECT COUNT(*) FROM kept)""",
    "base_headline": f"""
        SELECT COUNT(*) AS n_orders, round(AVG(days), 6) AS mean_days, round(median(days), 6) AS median_days,
               round(quantile_cont(days, 0.95), 6) AS p95_days, {_LATE} AS pct_late,
               round(AVG(err), 6) AS mean_promise_error, COUNT(*) FILTER (WHERE odd) AS n_approval_suspect
        FROM kept""",
    "promise_error_percentiles": """
        SELECT MIN(err) AS min_error, round(q[1], 6) AS p05, round(q[2], 6) AS p25, round(q[3], 6) AS median_error,
               round(q[4], 6) AS p75, round(q[5], 6) AS p95, MAX(err) AS max_error
        FROM kept, (SELECT quantile_cont(err, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM kept) GROUP BY q""",
    "promise_error_bands": f"""
        SELECT label AS bucket, COUNT(*) AS n_orders,
               round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM kept), 6) AS pct
        FROM kept JOIN {PROMISE} ON {_LAST} BETWEEN lo AND hi GROUP BY label""",
    "orders_segments": """
        SELECT oid AS order_id, bought AS purchased_at, days AS total_days, err AS promise_error_days,
               late AS is_late, odd AS approval_suspect, round(h1 / 24.0, 6) AS approval_days,
               round(h2 / 24.0, 6) AS handoff_days, round(h3 / 24.0, 6) AS transit_days FROM kept""",
    "segment_distributions": """
        SELECT segment, round(AVG(h / 24.0), 6) AS mean_days, round(median(h / 24.0), 6) AS median_days,
               round(quantile_cont(h / 24.0, 0.95), 6) AS p95_days, round(stddev_samp(h / 24.0), 6) AS stddev_days,
               round(quantile_cont(h / 24.0, 0.95) - median(h / 24.0), 6) AS tail_spread
        FROM (UNPIVOT (SELECT h1 AS approval, h2 AS handoff, h3 AS transit FROM kept WHERE NOT odd)
              ON approval, handoff, transit INTO NAME segment VALUE h) GROUP BY segment""",
    "segment_share": """
        SELECT round(AVG(h1) / 24.0, 6) AS approval, round(AVG(h2) / 24.0, 6) AS handoff, round(AVG(h3) / 24.0, 6) AS transit,
               round(100.0 * AVG(h1) / 24.0 / AVG(days), 6) AS pct_approval,
               round(100.0 * AVG(h2) / 24.0 / AVG(days), 6) AS pct_handoff,
               round(100.0 * AVG(h3) / 24.0 / AVG(days), 6) AS pct_transit FROM kept WHERE NOT odd""",
    "segments_by_lateness": """
        SELECT late AS is_late, COUNT(*) AS n_orders, round(median(h1) / 24.0, 6) AS approval,
               round(median(h2) / 24.0, 6) AS handoff, round(median(h3) / 24.0, 6) AS transit
        FROM kept WHERE NOT odd GROUP BY late""",
    "segment_sum_check": """
        SELECT COUNT(*) AS n_orders, round(AVG(h1 + h2 + h3) / 24.0, 6) AS sum_of_segments,
               round(AVG(days), 6) AS total_days_col, round(AVG(h1 + h2 + h3) / 24.0 - AVG(days), 6) AS gap
        FROM kept WHERE NOT odd""",
    "orders_geo": """
        SELECT oid AS order_id, days AS total_days, round(h3 / 24.0, 6) AS transit_days,
               round(h2 / 24.0, 6) AS handoff_days, err AS promise_error_days, late AS is_late,
               dstate AS customer_state FROM trusted""",
    "geo_join_check": """
        SELECT COUNT(*) AS n_rows, COUNT(dstate) AS has_state,
               COUNT(*) FILTER (WHERE dstate IS NULL) AS missing_state FROM trusted""",
    "state_transit_top15": f"""
        SELECT dstate AS customer_state, {_PLACE} FROM trusted
        GROUP BY dstate ORDER BY n_orders DESC, dstate NULLS LAST LIMIT 15""",
    "fastest_slowest_states": f"""
        {_extremes('fastest', 'ASC')} UNION ALL {_extremes('slowest', 'DESC')}""",
    "variance_by_state": """
        SELECT round(var_pop(h3 / 24.0), 6) AS total_variance, round(var_pop((h3 - mid) / 24.0), 6) AS within_state_variance,
               round(100.0 * (1 - var_pop(h3 - mid) / NULLIF(var_pop(h3), 0)), 6) AS pct_explained_by_state
        FROM (SELECT h3, median(h3) OVER (PARTITION BY dstate) AS mid FROM trusted WHERE dstate IS NOT NULL)""",
    "order_seller_profile": """
        SELECT oid AS order_id, items AS n_items, sellers AS n_sellers, states AS n_seller_states
        FROM kept JOIN baskets USING (oid)""",
    "items_coverage": """
        SELECT COUNT(*) AS orders_in_base, COUNT(*) FILTER (WHERE has) AS orders_with_items,
               COUNT(*) FILTER (WHERE NOT has) AS orders_missing_items
        FROM (SELECT oid IN (SELECT l_orderkey FROM lineitem) AS has FROM kept)""",
    "sellers_per_order": """
        SELECT sellers AS n_sellers, COUNT(*) AS n_orders, round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct
        FROM kept JOIN baskets USING (oid) GROUP BY sellers""",
    "seller_states_per_order": """
        SELECT states AS n_seller_states, COUNT(*) AS n_orders, round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct
        FROM kept JOIN baskets USING (oid) GROUP BY states""",
    "multi_seller_effect": f"""
        SELECT IF(sellers = 1, 'single seller', 'multi seller') AS grp, COUNT(*) AS n_orders,
               round(median(h3) / 24.0, 6) AS median_transit, round(quantile_cont(h3, 0.95) / 24.0, 6) AS p95_transit,
               {_LATE} AS pct_late
        FROM kept JOIN baskets USING (oid) WHERE NOT odd GROUP BY 1""",
    "dim_customer_geo": """
        SELECT cid AS customer_id, state AS customer_state, city AS customer_city,
               zip AS customer_zip_code_prefix FROM c_src""",
    "dim_seller_geo": """
        SELECT sid AS seller_id, state AS seller_state, city AS seller_city, zip AS seller_zip_code_prefix FROM s_src""",
    "order_origin": """
        SELECT oid AS order_id, origin AS seller_id, sellers AS n_sellers, states AS n_seller_states FROM baskets""",
    "fct_orders": """
        SELECT oid AS order_id, cid AS customer_id, origin AS seller_id, CAST(day AS VARCHAR) AS purchase_date,
               dstate AS customer_state, ostate AS seller_state, lane, ostate = dstate AS is_intrastate,
               days AS total_days, round(h1 / 24.0, 6) AS approval_days, round(h2 / 24.0, 6) AS handoff_days,
               round(h3 / 24.0, 6) AS transit_days, err AS promise_error_days, late AS is_late,
               odd AS approval_suspect, sellers AS n_sellers, states AS n_seller_states,
               states > 1 AS origin_ambiguous FROM facts""",
    "fact_integrity": """
        SELECT (SELECT COUNT(*) FROM kept) AS base_rows, COUNT(*) AS fact_rows, COUNT(DISTINCT oid) AS distinct_orders,
               COUNT(*) - COUNT(dstate) AS null_cust_state, COUNT(*) - COUNT(ostate) AS null_sell_state FROM facts""",
    "lane_coverage": """
        SELECT COUNT(DISTINCT lane) AS n_lanes, COUNT(*) FILTER (WHERE ostate = dstate) AS intrastate_orders,
               round(100.0 * COUNT(*) FILTER (WHERE ostate = dstate) / COUNT(ostate = dstate), 6) AS pct_intrastate,
               COUNT(*) FILTER (WHERE states > 1) AS ambiguous_origin_orders FROM facts""",
    "top_lanes": f"""
        SELECT lane, {_PLACE} FROM facts WHERE NOT odd GROUP BY lane
        ORDER BY n_orders DESC, lane NULLS LAST LIMIT 12""",
    "variance_dest_vs_lane": """
        SELECT round(var_pop(h3 / 24.0), 6) AS total_variance,
               round(100.0 * (1 - var_pop(h3 - by_dest) / NULLIF(var_pop(h3), 0)), 6) AS pct_explained_dest_only,
               round(100.0 * (1 - var_pop(h3 - by_pair) / NULLIF(var_pop(h3), 0)), 6) AS pct_explained_full_lane
        FROM (SELECT h3, dstate, lane, median(h3) OVER (PARTITION BY dstate) AS by_dest,
                     median(h3) OVER (PARTITION BY lane) AS by_pair FROM facts WHERE NOT odd)
        WHERE dstate IS NOT NULL AND lane IS NOT NULL""",
    "train_test_split": """
        SELECT IF(day < DATE '1999-07-01', '1_train', '2_test') AS split, COUNT(*) AS n_orders,
               CAST(MIN(day) AS VARCHAR) AS first_date, CAST(MAX(day) AS VARCHAR) AS last_date
        FROM facts GROUP BY 1""",
    "lane_threshold_coverage": """
        SELECT CAST(t AS BIGINT) AS min_orders, COUNT(past) AS n_lanes, CAST(SUM(future) AS BIGINT) AS test_orders_covered,
               round(100.0 * CAST(SUM(future) AS BIGINT) / (SELECT COUNT(*) FROM facts WHERE day >= DATE '1999-07-01'), 6) AS pct_covered
        FROM unnest([5, 10, 15, 20, 400]) AS sizes(t)
        LEFT JOIN (SELECT COUNT(*) FILTER (WHERE day < DATE '1999-07-01') AS past,
                          CASE WHEN lane IS NULL THEN 0 ELSE COUNT(*) FILTER (WHERE day >= DATE '1999-07-01') END AS future
                   FROM facts GROUP BY lane) ON past >= t
        GROUP BY t""",
    "lane_promise": f"SELECT lane, n AS n_train, {_QUANTILES} FROM by_lane",
    "state_promise": f"SELECT dstate AS customer_state, n AS n_train, {_QUANTILES} FROM by_state",
    "national_promise": f"SELECT {_QUANTILES} FROM overall",
    "test_eval": """
        SELECT oid AS order_id, lane, dstate AS customer_state, days AS total_days, late AS is_late,
               now AS current_promise_days, p90 AS new_90, p92 AS new_92, p95 AS new_95, tier AS promise_source
        FROM judged""",
    "fallback_usage": """
        SELECT tier AS promise_source, COUNT(*) AS n_orders,
               round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM judged), 6) AS pct FROM judged GROUP BY tier""",
    "policy_headline": f"""
        SELECT policy, round(AVG(promise), 6) AS mean_promise_days, round(AVG(now - promise), 6) AS mean_days_saved,
               round(100.0 * COUNT(*) FILTER (WHERE days <= promise) / COUNT(promise), 6) AS pct_on_time
        FROM {_POLICY} GROUP BY policy""",
    "lane_effect_p95": """
        SELECT lane, n AS n_test, round(a_now, 6) AS current_days, round(a_95, 6) AS recal_days,
               round(a_saved, 6) AS days_saved, round(s_now, 6) AS on_time_current, round(s_95, 6) AS on_time_recal
        FROM service ORDER BY n DESC, lane LIMIT 12""",
    "service_dispersion": f"""
        SELECT policy, round(MIN(s), 6) AS worst_lane, round(MAX(s), 6) AS best_lane,
               round(MAX(s) - MIN(s), 6) AS spread, round(stddev_samp(s), 6) AS stddev
        FROM {_SPREAD} WHERE n >= 5 GROUP BY policy""",
    "order_outcomes": """
        SELECT oid AS order_id, person AS customer_unique_id, CAST(day AS VARCHAR) AS purchase_date, days AS total_days,
               err AS promise_error_days, late AS is_late, CAST(stars AS BIGINT) AS review_score,
               round(CAST(paid AS DOUBLE), 6) AS order_value FROM results""",
    "outcome_coverage": """
        SELECT COUNT(*) AS n_orders, COUNT(stars) AS has_review, COUNT(paid) AS has_value, COUNT(person) AS has_customer
        FROM results""",
    "review_by_lateness": """
        SELECT late AS is_late, COUNT(*) AS n_orders, round(AVG(stars), 6) AS mean_score,
               round(100.0 * COUNT(*) FILTER (WHERE stars = 1) / COUNT(*), 6) AS pct_1_star,
               round(100.0 * COUNT(*) FILTER (WHERE stars <= 2) / COUNT(*), 6) AS pct_1_or_2,
               round(100.0 * COUNT(*) FILTER (WHERE stars = 5) / COUNT(*), 6) AS pct_5_star
        FROM results WHERE stars IS NOT NULL GROUP BY late""",
    "review_dose_response": f"""
        SELECT label AS bucket, COUNT(*) AS n_orders, round(AVG(stars), 6) AS mean_score,
               round(100.0 * COUNT(*) FILTER (WHERE stars = 1) / COUNT(*), 6) AS pct_1_star
        FROM results JOIN {REVIEW} ON {_LAST} BETWEEN lo AND hi WHERE stars IS NOT NULL GROUP BY label""",
    "repeat_within_90d": """
        SELECT late AS is_late, COUNT(*) AS n_customers,
               round(100.0 * COUNT(*) FILTER (WHERE again) / COUNT(*), 6) AS pct_repeat_90d
        FROM (SELECT late, EXISTS (SELECT 1 FROM o_src o JOIN c_src c ON c.cid = o.cid
                                   WHERE c.person = f.person
                                     AND date_diff('day', f.day, CAST(o.bought AS DATE)) BETWEEN 1 AND 90) AS again
              FROM (SELECT person, unnest(arg_min({'day': day, 'late': late}, (day, oid)))
                    FROM results GROUP BY person) f
              WHERE f.day <= DATE '2000-09-01')
        GROUP BY late""",
    "revenue_exposure": """
        SELECT late AS is_late, COUNT(*) AS n_orders, round(CAST(SUM(paid) AS DOUBLE), 6) AS total_brl,
               round(CAST(SUM(paid) AS DOUBLE) / COUNT(*), 6) AS mean_order_brl,
               round(100.0 * CAST(SUM(paid) AS DOUBLE) / (SELECT CAST(SUM(paid) AS DOUBLE) FROM results), 6) AS pct_of_revenue
        FROM results WHERE paid IS NOT NULL GROUP BY late""",
    "regressed_lanes": """
        SELECT lane, n, round(s_now, 6) AS ot_current, round(s_95, 6) AS ot_recal
        FROM service WHERE n >= 8 AND s_95 < s_now""",
    "promise_error_histogram": """
        SELECT day_error AS promise_error_days, COUNT(err) AS n_orders
        FROM generate_series(-45, 25) AS bins(day_error) LEFT JOIN facts ON err = day_error
        GROUP BY day_error""",
    "lateness_segment_medians": """
        SELECT late AS is_late, round(median(h1) / 24.0, 6) AS approval, round(median(h2) / 24.0, 6) AS handoff,
               round(median(h3) / 24.0, 6) AS transit FROM facts WHERE NOT odd GROUP BY late""",
    "lane_tail_vs_lateness": f"""
        SELECT lane, COUNT(*) AS n, round((quantile_cont(h3, 0.95) - median(h3)) / 24.0, 6) AS tail_spread,
               {_LATE} AS pct_late, round(median(h3) / 24.0, 6) AS median_transit
        FROM facts WHERE NOT odd GROUP BY lane HAVING n >= 15""",
    "worst_served_lanes": """
        SELECT lane, round(s_now, 6) AS ot_current, round(s_95, 6) AS ot_recal
        FROM service WHERE n >= 8 ORDER BY s_now, lane LIMIT 20""",
    "review_timing_bands": f"""
        SELECT label AS bucket, round(AVG(stars), 6) AS mean_score
        FROM results JOIN {REVIEW_CHART} ON {_LAST} BETWEEN lo AND hi WHERE stars IS NOT NULL GROUP BY label""",
    "inclusion_funnel": """
        SELECT stage, n, CASE WHEN stage[1] IN ('2', '3', '6') THEN lag(n) OVER (ORDER BY stage) - n END AS dropped
        FROM (SELECT '1 raw orders' AS stage, COUNT(*) AS n FROM o_src
              UNION ALL SELECT '2 delivered orders', COUNT(*) FROM o_src WHERE status = 'delivered'
              UNION ALL SELECT '3 analysis base', COUNT(*) FROM kept
              UNION ALL SELECT '4 test orders', COUNT(*) FROM judged
              UNION ALL SELECT '5 lanes with history', COUNT(lane) FROM by_lane
              UNION ALL SELECT '6 measurable lanes', COUNT(*) FROM service WHERE n >= 8)""",
    "tail_lateness_correlation": """
        SELECT COUNT(*) AS n_lanes, round(corr(late_rate, tail), 6) AS corr_tail_spread,
               round(corr(late_rate, mid), 6) AS corr_median_transit
        FROM (SELECT AVG(CAST(late AS INT)) AS late_rate, quantile_cont(h3, 0.95) - median(h3) AS tail, median(h3) AS mid
              FROM facts WHERE NOT odd GROUP BY lane HAVING COUNT(*) >= 15)""",
    "order_value_quantiles": """
        SELECT late AS is_late, COUNT(*) AS n_orders, round(AVG(v), 6) AS mean_value,
               round(quantile_cont(v, 0.5), 6) AS median_value, round(quantile_cont(v, 0.9), 6) AS p90_value,
               round(quantile_cont(v, 0.95), 6) AS p95_value, round(quantile_cont(v, 0.99), 6) AS p99_value
        FROM (SELECT late, CAST(paid AS DOUBLE) AS v FROM results WHERE paid IS NOT NULL) GROUP BY late""",
    "lane_promise_sketched": """
        SELECT lane, MAX(n) AS n_train, CAST(MIN(days) FILTER (WHERE up >= 0.90 * n) AS BIGINT) AS promise_90,
               CAST(MIN(days) FILTER (WHERE up >= 0.92 * n) AS BIGINT) AS promise_92,
               CAST(MIN(days) FILTER (WHERE up >= 0.95 * n) AS BIGINT) AS promise_95
        FROM (SELECT lane, days, COUNT(*) OVER (PARTITION BY lane) AS n,
                     row_number() OVER (PARTITION BY lane ORDER BY days) AS up FROM hist)
        GROUP BY lane HAVING MAX(n) >= 10""",
    "lane_coverage_curve": """
        SELECT t AS min_orders, COUNT(*) AS n_lanes, CAST(SUM(future) AS BIGINT) AS test_orders_covered,
               round(100.0 * CAST(SUM(future) AS BIGINT) / (SELECT COUNT(*) FROM facts WHERE day >= DATE '1999-07-01'), 6) AS pct_covered
        FROM (SELECT DISTINCT n AS t FROM (SELECT COUNT(*) AS n FROM hist GROUP BY lane)) sizes
        JOIN (SELECT COUNT(*) FILTER (WHERE day < DATE '1999-07-01') AS past,
                     CASE WHEN lane IS NULL THEN 0 ELSE COUNT(*) FILTER (WHERE day >= DATE '1999-07-01') END AS future
              FROM facts GROUP BY lane) ON past >= t
        GROUP BY t""",
    "variance_by_key_set": """
        SELECT key_set, n AS n_orders, round(within / 576, 6) AS within_variance,
               round(100.0 * (1 - within / NULLIF(whole, 0)), 6) AS pct_explained
        FROM (SELECT COUNT(*) AS n, var_pop(h3) AS whole,
                     unnest([{'key_set': 'destination', 'within': var_pop(h3 - m1)}, {'key_set': 'origin', 'within': var_pop(h3 - m2)},
                             {'key_set': 'lane', 'within': var_pop(h3 - m3)},
                             {'key_set': 'destination_and_month', 'within': var_pop(h3 - m4)}], recursive := true)
              FROM (SELECT h3, dstate, ostate, lane, median(h3) OVER (PARTITION BY dstate) AS m1,
                           median(h3) OVER (PARTITION BY ostate) AS m2, median(h3) OVER (PARTITION BY lane) AS m3,
                           median(h3) OVER (PARTITION BY dstate, strftime(day, '%Y-%m')) AS m4
                    FROM facts WHERE NOT odd)
              WHERE dstate IS NOT NULL AND ostate IS NOT NULL AND lane IS NOT NULL)""",
    "order_key_audit": """
        SELECT kind, COUNT(*) AS n_keys, CAST(SUM(n) AS BIGINT) AS n_rows,
               string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) FILTER (WHERE place <= 5) AS first_keys
        FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY oid) AS place
              FROM (SELECT COALESCE(b.oid, f.oid) AS oid, GREATEST(COALESCE(b.n, 0), COALESCE(f.n, 0)) AS n,
                           unnest([CASE WHEN f.n IS NULL THEN 'lost' END, CASE WHEN b.n IS NULL THEN 'foreign' END,
                                   CASE WHEN b.n > 1 THEN 'doubled' END, CASE WHEN f.n > b.n THEN 'fanned_out' END]) AS kind
                    FROM (SELECT oid, COUNT(*) AS n FROM kept GROUP BY oid) b
                    FULL JOIN (SELECT oid, COUNT(*) AS n FROM facts GROUP BY oid) f ON f.oid = b.oid)
              WHERE kind IS NOT NULL)
        GROUP BY kind""",
    "step_chain": """
        SELECT a AS from_step, b AS to_step, skipped AS n_skipped, COUNT(*) AS n_orders, round(AVG(h), 6) AS mean_hours,
               MIN(h) AS min_hours, MAX(h) AS max_hours
        FROM (SELECT 'purchased' AS a, 'approved' AS b, CAST(0 AS BIGINT) AS skipped, h1 AS h FROM kept
              UNION ALL SELECT 'approved', 'shipped', 0, h2 FROM kept
              UNION ALL SELECT 'shipped', 'promised', 0, date_diff('hour', scanned, due) FROM kept WHERE due IS NOT NULL
              UNION ALL SELECT 'promised', 'delivered', 0, date_diff('hour', due, arrived) FROM kept WHERE due IS NOT NULL
              UNION ALL SELECT 'shipped', 'delivered', 1, h3 FROM kept WHERE due IS NULL)
        GROUP BY ALL""",
    "late_rate_reduction": f"""
        SELECT policy, round(bad, 6) AS pct_late,
               round(100.0 * (bad - first_value(bad) OVER w) / first_value(bad) OVER w, 6) AS pct_change
        FROM (SELECT policy, 100.0 * COUNT(*) FILTER (WHERE days > promise) / COUNT(promise) AS bad
              FROM {_POLICY} GROUP BY policy) WINDOW w AS (ORDER BY policy)""",
    "dispersion_reduction": f"""
        SELECT policy, round(sd, 6) AS stddev,
               round(100.0 * (sd - first_value(sd) OVER w) / first_value(sd) OVER w, 6) AS pct_change
        FROM (SELECT policy, stddev_samp(s) AS sd FROM {_SPREAD} WHERE n >= 8 GROUP BY policy)
        WINDOW w AS (ORDER BY policy)""",
    "regression_summary": """
        SELECT COUNT(*) AS n_lanes, COUNT(*) FILTER (WHERE s_95 < s_now) AS n_regressed,
               round(100.0 * COUNT(*) FILTER (WHERE s_95 < s_now) / COUNT(*), 6) AS pct_regressed,
               round(AVG(s_95 - s_now) FILTER (WHERE s_95 < s_now), 6) AS mean_change,
               round(MIN(s_now) FILTER (WHERE s_95 < s_now), 6) AS min_before,
               round(MIN(s_95) FILTER (WHERE s_95 < s_now), 6) AS min_after FROM service WHERE n >= 8""",
    "late_to_ontime_conversion": """
        SELECT moved AS converted_orders, round(gap, 6) AS one_star_gap, round(moved * gap / 100, 6) AS one_star_reviews_avoided
        FROM (SELECT COUNT(*) FILTER (WHERE days > p90 AND days <= p95) AS moved FROM judged),
             (SELECT 100.0 * COUNT(*) FILTER (WHERE late AND stars = 1) / COUNT(*) FILTER (WHERE late)
                   - 100.0 * COUNT(*) FILTER (WHERE NOT late AND stars = 1) / COUNT(*) FILTER (WHERE NOT late) AS gap
              FROM results WHERE stars IS NOT NULL)""",
}


# The same question, answered in another way.
REPORTS["repeat_by_frame"] = REPORTS["repeat_within_90d"]


def _needed(text: str) -> set[str]:
    found = {name for name in PARTS if re.search(rf"\b{name}\b", text)}
    for name in list(found):
        found |= _needed(PARTS[name])
    return found


def statement(report: str) -> str:
    body = REPORTS[report].strip()
    needed = _needed(body)
    order = list(PARTS)
    order.insert(order.index("kept") + 1, order.pop(order.index("trusted")))
    parts = [f"{name} AS ({PARTS[name].strip()})" for name in order if name in needed]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
