"""SQL of named queries for the checking engine, written apart from the queries: whole cents from the base tables, and that
engine's own ranks, tiles and windows. Where one of these names stands in ORACLES, nothing of plans/library.py is in it."""

from __future__ import annotations


def two(x: str, n: int = 2) -> str:
    """Rounded half up from six digits, the queries' way to give a number."""
    return f"CAST(round(CAST({x} AS DECIMAL(24,6)), {n}) AS DOUBLE)"


LINES = """lines AS (
  SELECT CAST(o_orderdate AS DATE) AS day, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS first,
    o_custkey AS customer, l_partkey AS part, p_name AS name, p_type AS category, r_name AS region, c_mktsegment AS segment, l_suppkey AS supplier,
    CAST(l_quantity AS BIGINT) AS units, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(l_discount * 10000) AS BIGINT) AS rate, CAST(round(p_retailprice * 100) AS BIGINT) AS price
  FROM lineitem, orders, customer, nation, region, part
  WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_partkey = p_partkey
),
cents AS (
  SELECT *, (gross * rate + 5000) // 10000 AS off, gross - (gross * rate + 5000) // 10000 AS revenue, (units * price * 90 + 50) // 100 AS cost FROM lines
)"""
MONTHS = """months AS (
  SELECT ym, any_value(first) AS first, count(*) AS n, count(DISTINCT customer) AS customers, sum(revenue) / 100.0 AS revenue, sum(revenue - cost) / 100.0 AS profit,
    sum(revenue - cost) * 100.0 / sum(revenue) AS margin, sum(off) * 100.0 / sum(gross) AS rate
  FROM cents GROUP BY ym
)"""
PRODUCTS = """products AS (
  SELECT part, any_value(name) AS name, any_value(category) AS category, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, sum(revenue) / 100.0 AS revenue, sum(cost) / 100.0 AS cost,
    sum(revenue - cost) / 100.0 AS profit, sum(revenue - cost) * 100.0 / sum(revenue) AS margin, sum(off) * 100.0 / sum(gross) AS rate
  FROM cents GROUP BY part
)"""
ORACLES = {
    "q01_monthly_revenue_trend": f"""WITH {LINES}, {MONTHS}
SELECT first AS month_start, ym AS year_month, {two('revenue')} AS revenue, {two('profit')} AS profit, {two('margin')} AS profit_margin_pct, n AS transactions, customers AS active_customers,
  {two('revenue / n')} AS avg_transaction_value, {two('rate')} AS discount_rate_pct, {two('lag(revenue) OVER w')} AS prev_month_revenue, {two('(revenue / lag(revenue) OVER w - 1) * 100')} AS mom_growth_pct,
  {two('avg(revenue) OVER three')} AS revenue_3mo_ma, {two('avg(margin) OVER three')} AS margin_3mo_ma, {two('sum(revenue) OVER w')} AS cumulative_revenue
FROM months WINDOW w AS (ORDER BY ym), three AS (ORDER BY ym ROWS 2 PRECEDING)""",
    "q08_profit_by_product": f"""WITH {LINES}, {PRODUCTS}
SELECT part AS product_id, name AS product_name, category AS product_category, n AS transactions, units AS units_sold, {two('revenue')} AS revenue, {two('cost')} AS cost, {two('profit')} AS profit,
  {two('margin')} AS profit_margin_pct, {two('rate')} AS discount_rate_pct, {two('revenue / units')} AS avg_realised_price, rank() OVER (ORDER BY profit DESC) AS profit_rank_overall,
  rank() OVER (PARTITION BY category ORDER BY profit DESC) AS profit_rank_in_category, {two('profit * 100 / nullif(sum(profit) OVER (PARTITION BY category), 0)')} AS pct_of_category_profit
FROM products""",
    "q09_high_revenue_low_margin_products": f"""WITH {LINES}, {PRODUCTS}, placed AS (SELECT *, percent_rank() OVER (ORDER BY revenue) AS big, percent_rank() OVER (ORDER BY margin NULLS FIRST) AS rich FROM products)
SELECT part AS product_id, name AS product_name, category AS product_category, units AS units_sold, {two('revenue')} AS revenue, {two('profit')} AS profit, {two('margin')} AS profit_margin_pct, {two('rate')} AS discount_rate_pct,
  {two('big * 100', 1)} AS revenue_percentile, {two('rich * 100', 1)} AS margin_percentile, {two('revenue / 100')} AS profit_uplift_per_margin_point
FROM placed WHERE big >= 0.5 AND rich <= 0.25""",
    "q12_customer_concentration": f"""WITH {LINES}, each AS (SELECT customer, sum(revenue) AS revenue, sum(revenue - cost) AS profit FROM cents WHERE customer % 50 <> 0 GROUP BY customer),
tiles AS (SELECT *, ntile(10) OVER (ORDER BY revenue DESC, customer) AS tile FROM each), t AS (SELECT tile, count(*) AS n, sum(revenue) / 100.0 AS revenue, sum(profit) / 100.0 AS profit FROM tiles GROUP BY tile)
SELECT CAST(tile AS BIGINT) AS revenue_decile, n AS customers, revenue, profit, {two('revenue / n')} AS avg_revenue_per_customer, {two('revenue * 100 / sum(revenue) OVER ()')} AS pct_of_revenue,
  {two('sum(revenue) OVER (ORDER BY tile) * 100 / sum(revenue) OVER ()')} AS cumulative_pct_of_revenue FROM t""",
    "q14_repeat_purchase_behaviour": f"""WITH {LINES}, each AS (SELECT customer, count(*) AS orders, count(DISTINCT ym) AS months, sum(revenue) / 100.0 AS revenue FROM cents WHERE customer % 50 <> 0 GROUP BY customer),
bands AS (SELECT CASE WHEN orders > 50 THEN '50+' WHEN orders > 20 THEN '21-50' WHEN orders > 5 THEN '6-20' WHEN orders > 1 THEN '2-5' ELSE '1' END || CASE WHEN orders > 1 THEN ' orders' ELSE ' order' END AS band, * FROM each),
b AS (SELECT band, count(*) AS n, sum(orders) AS orders, sum(months) AS months, sum(revenue) AS revenue FROM bands GROUP BY band)
SELECT band AS order_band, n AS customers, {two('n * 100.0 / sum(n) OVER ()')} AS pct_of_customers, {two('revenue')} AS revenue, {two('revenue * 100 / sum(revenue) OVER ()')} AS pct_of_revenue,
  {two('revenue / n')} AS avg_lifetime_revenue, {two('orders * 1.0 / n', 1)} AS avg_orders, {two('months * 1.0 / n', 1)} AS avg_active_months FROM b""",
    "q15_customer_cohort_retention": f"""WITH {LINES}, seen AS (SELECT DISTINCT customer, first FROM cents WHERE customer % 50 <> 0), start AS (SELECT customer, min(first) AS cohort FROM seen GROUP BY customer),
size AS (SELECT cohort, count(*) AS customers FROM start GROUP BY cohort)
SELECT strftime(cohort, '%Y-%m') AS cohort_month, any_value(customers) AS cohort_customers, date_diff('month', cohort, first) AS month_offset, count(*) AS active_customers, {two('count(*) * 100.0 / any_value(customers)')} AS retention_pct
FROM seen JOIN start USING (customer) JOIN size USING (cohort) GROUP BY cohort, first""",
    "q17_discount_impact": f"""WITH {LINES}, bands AS (
  SELECT list_extract(['A. 0%', 'B. 0-5%', 'C. 5-10%', 'D. 10-15%', 'E. 15-25%', 'F. 25-40%', 'G. 40%+'], 1 + CAST(len(list_filter([0, 500, 1000, 1500, 2500, 4000], lambda edge: rate > edge)) AS INTEGER)) AS band, * FROM cents
), b AS (SELECT band, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, sum(gross) / 100.0 AS gross, sum(off) / 100.0 AS off, sum(revenue) / 100.0 AS revenue, sum(revenue - cost) / 100.0 AS profit, count(*) FILTER (revenue < cost) AS losses FROM bands GROUP BY band)
SELECT band AS discount_band, n AS transactions, {two('n * 100.0 / sum(n) OVER ()')} AS pct_of_transactions, {two('units * 1.0 / n', 1)} AS avg_quantity, {two('gross')} AS gross_revenue, {two('off')} AS discount_given, {two('revenue')} AS revenue,
  {two('profit')} AS profit, {two('profit * 100 / nullif(revenue, 0)')} AS profit_margin_pct, {two('revenue / n')} AS avg_order_value, losses AS loss_making_transactions, {two('revenue * 100 / sum(revenue) OVER ()')} AS pct_of_revenue FROM b""",
    "q21_marketing_efficiency": f"""WITH {LINES}, spent AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS first, r_name AS region, sum((CAST(round(l_extendedprice * 100) AS BIGINT) + 50) // 100) / 100.0 AS spend
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), earned AS (SELECT first, region, sum(revenue) / 100.0 AS revenue FROM cents GROUP BY ALL)
SELECT first AS month, region, {two('spend')} AS marketing_spend, {two('revenue')} AS revenue, {two('lead(revenue) OVER w')} AS next_month_revenue, {two('revenue / nullif(spend, 0)')} AS revenue_per_marketing_dollar,
  {two('spend * 100 / nullif(revenue, 0)')} AS marketing_pct_of_revenue, {two('(spend / lag(spend) OVER w - 1) * 100')} AS spend_mom_pct, {two('(revenue / lag(revenue) OVER w - 1) * 100')} AS revenue_mom_pct
FROM spent JOIN earned USING (first, region) WINDOW w AS (PARTITION BY region ORDER BY first)""",
}
