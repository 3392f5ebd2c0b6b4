"""Relational queries over the star-schema tables: joins, grouping, windows, sets, sessions."""

from __future__ import annotations

from .pairs import Family

FAMILY = Family()
S = FAMILY.sql
S("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
S("revenue_by_nation", "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name")
S("customers_with_orders", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
S("customers_without_orders", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
S("supplier_price_bands", "SELECT s.s_suppkey, count(*) AS parts FROM {supplier} s JOIN {part} p ON p.p_size = s.s_suppkey % 50 + 1 AND p.p_retailprice BETWEEN s.s_acctbal / 10 AND s.s_acctbal GROUP BY s.s_suppkey")
S("order_cube", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS gs, grouping(o_orderpriority) AS gp, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
S("order_rollup", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS gs, grouping(o_orderpriority) AS gp, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
S("running_totals", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders}")
S("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM {events}")
S("top_orders_per_customer", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) SELECT o_custkey, o_orderkey, k FROM r WHERE k <= 3")
S("set_operations", "(SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) UNION (SELECT n_nationkey FROM {nation} EXCEPT SELECT c_nationkey FROM {customer})")
S("event_sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new FROM {events}), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, CAST(max(session) AS BIGINT) AS sessions, count(*) AS events FROM s GROUP BY user_id")
S("hourly_windows", "SELECT CAST(date_trunc('HOUR', ts) AS STRING) AS hour, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
S("event_funnel", "SELECT user_id, count(DISTINCT event_type) AS kinds, min(event_id) AS first_event, max(event_id) AS last_event FROM {events} GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
S("label_balance", "SELECT d.lang, l.quality, l.toxic, count(*) AS n FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang, l.quality, l.toxic")
S("part_type_counts", "SELECT p_brand, sum(CASE WHEN p_size < 10 THEN 1 ELSE 0 END) AS small, sum(CASE WHEN p_size BETWEEN 10 AND 30 THEN 1 ELSE 0 END) AS medium, sum(CASE WHEN p_size > 30 THEN 1 ELSE 0 END) AS large FROM {part} GROUP BY p_brand")
S("priority_pivot", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS p5 FROM {orders} GROUP BY o_orderstatus")
