"""The library of named business queries, as SQL over the star schema.

Every query has a tie-breaking key where it ranks or cuts, decimal sums (cast to double before a division), and an
alias for every output, so that another engine can check it row by row. Customers and products grow with the data, so
they are ranked in two levels (`ordered`): value cells, whose counts and sums are added up in order, and rows within a cell.
"""

from __future__ import annotations


def S(x: str) -> str:
    return f"CAST(SUM({x}) AS DOUBLE)"


def N(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def R(x: str, n: int = 2) -> str:
    """Rounded half up by way of a decimal, so that engines agree."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(24,6)), {n}) AS DOUBLE)"


def pct(a: str, b: str) -> str:
    return R(f"({a}) * 100.0E0 / NULLIF({b}, 0)")


def growth(x: str, lag: int, w: str = "w") -> str:
    """Percent change of x against the row `lag` rows before; a missing period shifts the comparison."""
    return R(f"({x} - LAG({x}, {lag}) OVER {w}) * 100.0E0 / NULLIF(LAG({x}, {lag}) OVER {w}, 0)")


def ma3(x: str, part: str = "") -> str:
    """Mean of up to three rows, partial at the start."""
    return R(f"AVG({x}) OVER ({part} ORDER BY month_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")


def money(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DECIMAL(18,2))"


def ordered(name: str, source: str, x: str, key: str, down: bool = True, add: bool = False) -> str:
    """CTEs that end in `name`: source with {name}_rank, {name}_at (its place), {name}_n (rows in all); with add, also {name}_sum (up to the row) and {name}_total.

    A row's cell follows from x alone (64 cells to a doubling), so it needs no look at the data first; windows run within
    cells, and what comes before a cell is summed over the few cells there are.
    """
    cell = f"COALESCE(CAST(SIGN({x}) * FLOOR(64 * LOG2(1 + ABS(CAST({x} AS DOUBLE)))) AS BIGINT), -1000000)"
    way, to = ("DESC NULLS LAST", "DESC") if down else ("ASC NULLS FIRST", "ASC")
    before = f"OVER (ORDER BY {name}_cell {to} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    here = f"OVER (PARTITION BY c.{name}_cell ORDER BY c.{x} {way}"
    sums = f", SUM(SUM({x})) OVER () AS {name}_total, COALESCE(SUM(SUM({x})) {before}, 0) AS s0" if add else ""
    running = f", s0 + SUM(c.{x}) {here}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {name}_sum, {name}_total" if add else ""
    return f"""{name}_c AS (SELECT s.*, {cell} AS {name}_cell FROM {source} s),
{name}_o AS (SELECT {name}_cell, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS {name}_n, CAST(COALESCE(SUM(COUNT(*)) {before}, 0) AS BIGINT) AS n0{sums} FROM {name}_c GROUP BY {name}_cell),
{name} AS (SELECT c.*, n0 + RANK() {here}) AS {name}_rank, n0 + ROW_NUMBER() {here}, {key}) AS {name}_at, {name}_n{running} FROM {name}_c c JOIN {name}_o o ON c.{name}_cell = o.{name}_cell)"""


def tile(at: str, n: str, tiles: int = 10) -> str:
    """The tile of place `at` among n rows, as NTILE deals them out: the first n % tiles tiles have one row more."""
    q, r = f"CAST(FLOOR({n} / {tiles}.0E0) AS BIGINT)", f"({n} % {tiles})"
    return f"CAST(CASE WHEN {at} <= {r} * ({q} + 1) THEN FLOOR(({at} - 1) / ({q} + 1.0E0)) ELSE {r} + FLOOR(({at} - 1 - {r} * ({q} + 1)) / CAST(GREATEST({q}, 1) AS DOUBLE)) END AS BIGINT) + 1"


#: Labels and edges of the bands.
BAND = "CASE WHEN discount = 0 THEN 'A. 0%' WHEN discount <= 0.05 THEN 'B. 0-5%' WHEN discount <= 0.10 THEN 'C. 5-10%' WHEN discount <= 0.15 THEN 'D. 10-15%' WHEN discount <= 0.25 THEN 'E. 15-25%' WHEN discount <= 0.40 THEN 'F. 25-40%' ELSE 'G. 40%+' END"
ORDERS = "CASE WHEN orders = 1 THEN '1 order' WHEN orders BETWEEN 2 AND 5 THEN '2-5 orders' WHEN orders BETWEEN 6 AND 20 THEN '6-20 orders' WHEN orders BETWEEN 21 AND 50 THEN '21-50 orders' ELSE '50+ orders' END"
CORE = f"COUNT(*) AS transactions, {N('quantity')} AS units_sold, {S('gross_revenue')} AS gross_revenue, {S('discount_amount')} AS discount_given, {S('revenue')} AS revenue, {S('cost')} AS cost, {S('profit')} AS profit"
MARGIN, DISCOUNT, COST = f"{pct('profit', 'revenue')} AS profit_margin_pct", f"{pct('discount_given', 'gross_revenue')} AS discount_rate_pct", f"{pct('cost', 'revenue')} AS cost_to_revenue_pct"
SHARES = f"{pct('revenue', 'SUM(revenue) OVER ()')} AS pct_of_revenue, {pct('profit', 'SUM(profit) OVER ()')} AS pct_of_profit"
AOV = f"{R('revenue / transactions')} AS avg_order_value"
MONTH = "month_start, year_month"

VIEWS = {
    "v1_monthly_revenue": "SELECT month_start, year_month, year, quarter, transactions, active_customers, units_sold, gross_revenue, discount_amount, revenue, cost, profit, profit_margin_pct, discount_rate_pct, avg_transaction_value FROM v_monthly_revenue",
    "v2_monthly_pnl": "SELECT month_start, revenue, cogs, gross_profit, gross_margin_pct, operating_expenses, payroll_cost, marketing_spend, headcount, operating_profit, operating_margin_pct FROM v_monthly_pnl",
    "v3_customer_summary": "SELECT * FROM v_customer_summary",
    "v4_product_summary": "SELECT * FROM v_product_summary",
    "p06_date_dimension": "SELECT * FROM dim_date",
}


def fact(keys: str, condition: str = "1 = 1", more: str = "") -> str:
    """The core sums of the ledger by some keys."""
    return f"SELECT {keys}, {CORE}{more} FROM fact_transactions WHERE {condition} GROUP BY {keys}"


CUSTOMERS = ", COUNT(DISTINCT customer_id) AS customers"
NAMED = {
    "q01_monthly_revenue_trend": f"""SELECT {MONTH}, {R('revenue')} AS revenue, {R('profit')} AS profit, {R('profit_margin_pct')} AS profit_margin_pct, transactions, active_customers, {R('avg_transaction_value')} AS avg_transaction_value, {R('discount_rate_pct')} AS discount_rate_pct,
  {R('LAG(revenue) OVER w')} AS prev_month_revenue, {growth('revenue', 1)} AS mom_growth_pct, {ma3('revenue')} AS revenue_3mo_ma, {ma3('profit_margin_pct')} AS margin_3mo_ma,
  {R('SUM(revenue) OVER (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cumulative_revenue FROM v_monthly_revenue WINDOW w AS (ORDER BY month_start) ORDER BY month_start""",
    "q02_yoy_growth_by_month": f"""SELECT {MONTH}, {R('revenue')} AS revenue, {R('LAG(revenue, 12) OVER w')} AS revenue_ly, {growth('revenue', 12)} AS revenue_yoy_pct, {R('profit')} AS profit, {R('LAG(profit, 12) OVER w')} AS profit_ly, {growth('profit', 12)} AS profit_yoy_pct,
  {R('profit_margin_pct')} AS profit_margin_pct, {R('profit_margin_pct - LAG(profit_margin_pct, 12) OVER w')} AS margin_change_pp FROM v_monthly_revenue WINDOW w AS (ORDER BY month_start) ORDER BY month_start""",
    "q03_annual_summary": f"""WITH y AS ({fact('year', more=CUSTOMERS)})
SELECT year, {R('revenue')} AS revenue, {R('cost')} AS cost, {R('profit')} AS profit, {pct('profit', 'revenue')} AS gross_margin_pct, {COST}, {pct('discount_given', 'revenue + discount_given')} AS discount_rate_pct, transactions, customers, {AOV}, {R('revenue / NULLIF(customers, 0)')} AS revenue_per_customer,
  {growth('revenue', 1)} AS revenue_growth_pct, {growth('profit', 1)} AS profit_growth_pct, {growth('cost', 1)} AS cost_growth_pct FROM y WINDOW w AS (ORDER BY year) ORDER BY year""",
    "q04_quarterly_performance": f"""WITH q AS ({fact('year_quarter, year, quarter')})
SELECT year_quarter, {R('revenue')} AS revenue, {R('profit')} AS profit, {MARGIN}, transactions, {growth('revenue', 1)} AS qoq_growth_pct, {growth('revenue', 4)} AS yoy_growth_pct FROM q WINDOW w AS (ORDER BY year, quarter) ORDER BY year_quarter""",
    "q05_revenue_by_region": f"""WITH r AS ({fact('region', more=CUSTOMERS)})
SELECT region, transactions, customers, {R('revenue')} AS revenue, {R('cost')} AS cost, {R('profit')} AS profit, {MARGIN}, {SHARES}, {AOV}, {DISCOUNT}, RANK() OVER (ORDER BY revenue DESC) AS revenue_rank, RANK() OVER (ORDER BY profit DESC) AS profit_rank FROM r ORDER BY revenue DESC, region""",
    "q06_region_monthly_trend": f"""WITH r AS ({fact('region, month_start, year_month')})
SELECT region, {MONTH}, {R('revenue')} AS revenue, {R('profit')} AS profit, {MARGIN}, {growth('revenue', 1)} AS mom_growth_pct, {ma3('revenue', 'PARTITION BY region')} AS revenue_3mo_ma FROM r WINDOW w AS (PARTITION BY region ORDER BY month_start) ORDER BY region, month_start""",
    "q07_margin_by_category": f"""WITH c AS ({fact('product_category')})
SELECT product_category, transactions, units_sold, {R('gross_revenue')} AS gross_revenue, {R('discount_given')} AS discount_given, {R('revenue')} AS revenue, {R('cost')} AS cost, {R('profit')} AS profit, {MARGIN}, {DISCOUNT}, {SHARES}, RANK() OVER (ORDER BY profit / NULLIF(revenue, 0) DESC NULLS LAST) AS margin_rank FROM c ORDER BY profit DESC, product_category""",
    "q08_profit_by_product": f"""WITH {ordered('p', 'v_product_summary', 'profit', 'c.product_id')},
k AS (SELECT product_category, SUM({money('profit')}) AS category_profit FROM v_product_summary GROUP BY 1),
i AS (SELECT p.*, CAST(SUM(COUNT(*)) OVER (PARTITION BY product_category ORDER BY p_cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM (SELECT product_category, p_cell FROM p_c) p GROUP BY product_category, p_cell)
SELECT p.product_id, product_name, p.product_category, transactions, units_sold, {R('revenue')} AS revenue, {R('cost')} AS cost, {R('profit')} AS profit, {R('profit_margin_pct')} AS profit_margin_pct, {R('discount_rate_pct')} AS discount_rate_pct, {R('avg_realised_price')} AS avg_realised_price, p_rank AS profit_rank_overall,
  COALESCE(before, 0) + RANK() OVER (PARTITION BY p.product_category, p.p_cell ORDER BY profit DESC) AS profit_rank_in_category, {pct('profit', 'CAST(category_profit AS DOUBLE)')} AS pct_of_category_profit
FROM p JOIN k ON p.product_category = k.product_category JOIN i ON p.product_category = i.product_category AND p.p_cell = i.p_cell ORDER BY profit DESC, product_id""",
    "q09_high_revenue_low_margin_products": f"""WITH {ordered('r', 'v_product_summary', 'revenue', 'c.product_id', down=False)}, {ordered('m', 'r', 'profit_margin_pct', 'c.product_id', down=False)},
t AS (SELECT m.*, (r_rank - 1) / CAST(GREATEST(r_n - 1, 1) AS DOUBLE) AS revenue_pctile, (m_rank - 1) / CAST(GREATEST(m_n - 1, 1) AS DOUBLE) AS margin_pctile FROM m)
SELECT product_id, product_name, product_category, units_sold, {R('revenue')} AS revenue, {R('profit')} AS profit, {R('profit_margin_pct')} AS profit_margin_pct, {R('discount_rate_pct')} AS discount_rate_pct, {R('revenue_pctile * 100', 1)} AS revenue_percentile, {R('margin_pctile * 100', 1)} AS margin_percentile, {R('revenue * 0.01E0')} AS profit_uplift_per_margin_point
FROM t WHERE revenue_pctile >= 0.5E0 AND margin_pctile <= 0.25E0 ORDER BY revenue DESC, product_id""",
    "q10_discount_heavy_products": f"""SELECT product_id, product_name, product_category, units_sold, {R('gross_revenue')} AS gross_revenue, {R('gross_revenue - revenue')} AS discount_given, {R('revenue')} AS revenue, {R('profit')} AS profit, {R('discount_rate_pct')} AS discount_rate_pct, {R('profit_margin_pct')} AS profit_margin_pct, RANK() OVER (ORDER BY discount_rate_pct DESC) AS discount_rank
FROM (SELECT * FROM v_product_summary WHERE units_sold > 100 ORDER BY discount_rate_pct DESC, product_id LIMIT 25) t ORDER BY discount_rate_pct DESC, product_id""",
    "q11_top_customers": f"""WITH t AS (SELECT *, {money('revenue')} AS exact FROM v_customer_summary ORDER BY revenue DESC, customer_id LIMIT 30), g AS (SELECT SUM({money('revenue')}) AS total FROM v_customer_summary),
r AS (SELECT t.*, ROW_NUMBER() OVER w AS revenue_rank, SUM(exact) OVER (ORDER BY revenue DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM t WINDOW w AS (ORDER BY revenue DESC, customer_id))
SELECT revenue_rank, customer_id, customer_segment, region, transactions, active_months, {R('revenue')} AS revenue, {R('profit')} AS profit, {R('profit_margin_pct')} AS profit_margin_pct, {R('avg_order_value')} AS avg_order_value, {R('discount_rate_pct')} AS discount_rate_pct,
  {R('revenue * 100.0E0 / CAST(total AS DOUBLE)', 3)} AS pct_of_revenue, {pct('CAST(running AS DOUBLE)', 'CAST(total AS DOUBLE)')} AS cumulative_pct_of_revenue FROM r CROSS JOIN g ORDER BY revenue_rank""",
    "q12_customer_concentration": f"""WITH v AS (SELECT customer_id, {money('revenue')} AS revenue, {money('profit')} AS profit FROM v_customer_summary), {ordered('c', 'v', 'revenue', 'c.customer_id')},
d AS (SELECT {tile('c_at', 'c_n')} AS revenue_decile, COUNT(*) AS customers, SUM(revenue) AS revenue, SUM(profit) AS profit FROM c GROUP BY 1)
SELECT revenue_decile, customers, CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit, {R('CAST(revenue AS DOUBLE) / customers')} AS avg_revenue_per_customer, {pct('CAST(revenue AS DOUBLE)', 'CAST(SUM(revenue) OVER () AS DOUBLE)')} AS pct_of_revenue,
  {pct('CAST(SUM(revenue) OVER (ORDER BY revenue_decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)', 'CAST(SUM(revenue) OVER () AS DOUBLE)')} AS cumulative_pct_of_revenue FROM d ORDER BY revenue_decile""",
    "q13_customer_segment_performance": f"""WITH s AS ({fact('customer_segment', 'is_customer_attributed = 1', CUSTOMERS)})
SELECT customer_segment, customers, transactions, {R('revenue')} AS revenue, {R('profit')} AS profit, {MARGIN}, {AOV}, {R('revenue / customers')} AS revenue_per_customer, {DISCOUNT}, {pct('revenue', 'SUM(revenue) OVER ()')} AS pct_of_revenue FROM s ORDER BY revenue DESC, customer_segment""",
    "q14_repeat_purchase_behaviour": f"""WITH c AS (SELECT customer_id, customer_segment, COUNT(*) AS orders, COUNT(DISTINCT year_month) AS active_months, SUM(revenue) AS revenue FROM fact_transactions WHERE is_customer_attributed = 1 GROUP BY 1, 2),
b AS (SELECT {ORDERS} AS order_band, COUNT(*) AS customers, CAST(SUM(orders) AS DOUBLE) AS orders, CAST(SUM(active_months) AS DOUBLE) AS months, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM c GROUP BY 1)
SELECT order_band, customers, {pct('customers', 'SUM(customers) OVER ()')} AS pct_of_customers, {R('revenue')} AS revenue, {pct('revenue', 'SUM(revenue) OVER ()')} AS pct_of_revenue, {R('revenue / customers')} AS avg_lifetime_revenue, {R('orders / customers', 1)} AS avg_orders, {R('months / customers', 1)} AS avg_active_months FROM b ORDER BY avg_orders""",
    "q15_customer_cohort_retention": f"""WITH a AS (SELECT DISTINCT customer_id, year_month FROM fact_transactions WHERE is_customer_attributed = 1),
f AS (SELECT customer_id, year_month, MIN(year_month) OVER (PARTITION BY customer_id) AS cohort_month FROM a),
o AS (SELECT cohort_month, (CAST(SUBSTR(year_month, 1, 4) AS BIGINT) * 12 + CAST(SUBSTR(year_month, 6, 2) AS BIGINT)) - (CAST(SUBSTR(cohort_month, 1, 4) AS BIGINT) * 12 + CAST(SUBSTR(cohort_month, 6, 2) AS BIGINT)) AS month_offset, COUNT(*) AS active_customers FROM f GROUP BY 1, 2),
z AS (SELECT o.*, MAX(CASE WHEN month_offset = 0 THEN active_customers END) OVER (PARTITION BY cohort_month) AS cohort_customers FROM o)
SELECT cohort_month, cohort_customers, month_offset, active_customers, {pct('active_customers', 'cohort_customers')} AS retention_pct FROM z ORDER BY cohort_month, month_offset""",
    "q16_avg_transaction_value": f"""WITH a AS (SELECT customer_segment, region, COUNT(*) AS transactions, {S('revenue')} / COUNT(*) AS mean, CAST(MIN(revenue) AS DOUBLE) AS least, CAST(MAX(revenue) AS DOUBLE) AS most, {S('revenue')} AS revenue FROM fact_transactions WHERE is_customer_attributed = 1 GROUP BY 1, 2)
SELECT customer_segment, region, transactions, {R('mean')} AS avg_transaction_value, least AS min_transaction_value, most AS max_transaction_value, {R('revenue')} AS revenue, {R('AVG(mean) OVER (PARTITION BY customer_segment)')} AS segment_avg_transaction_value, {R('mean - AVG(mean) OVER (PARTITION BY customer_segment)')} AS deviation_from_segment_avg FROM a ORDER BY customer_segment, avg_transaction_value DESC, region""",
    "q17_discount_impact": f"""WITH f AS (SELECT {BAND} AS discount_band, quantity, gross_revenue, discount_amount, revenue, cost, profit, is_loss_making FROM fact_transactions), b AS (SELECT discount_band, {CORE}, {N('is_loss_making')} AS losses FROM f GROUP BY 1)
SELECT discount_band, transactions, {pct('transactions', 'SUM(transactions) OVER ()')} AS pct_of_transactions, {R('units_sold * 1.0E0 / transactions', 1)} AS avg_quantity, {R('gross_revenue')} AS gross_revenue, {R('discount_given')} AS discount_given, {R('revenue')} AS revenue, {R('profit')} AS profit, {MARGIN}, {AOV}, losses AS loss_making_transactions, {pct('revenue', 'SUM(revenue) OVER ()')} AS pct_of_revenue FROM b ORDER BY discount_band""",
    "q18_cost_trend": f"""SELECT {MONTH}, {R('revenue')} AS revenue, {R('cost')} AS cost, {COST}, {R('cost / NULLIF(units_sold, 0)')} AS cost_per_unit, {growth('revenue', 12)} AS revenue_yoy_pct, {growth('cost', 12)} AS cost_yoy_pct,
  {R('(cost - LAG(cost, 12) OVER w) * 100.0E0 / NULLIF(LAG(cost, 12) OVER w, 0) - (revenue - LAG(revenue, 12) OVER w) * 100.0E0 / NULLIF(LAG(revenue, 12) OVER w, 0)')} AS cost_minus_revenue_growth_pp, {ma3('cost * 100.0E0 / NULLIF(revenue, 0)')} AS cost_ratio_3mo_ma FROM v_monthly_revenue WINDOW w AS (ORDER BY month_start) ORDER BY month_start""",
    "q19_operating_cost_structure": f"""SELECT month_start, {R('revenue')} AS revenue, {R('cogs')} AS cogs, {R('gross_profit')} AS gross_profit, {R('gross_margin_pct')} AS gross_margin_pct, {R('operating_expenses')} AS operating_expenses, {R('payroll_cost')} AS payroll_cost, {R('marketing_spend')} AS marketing_spend, headcount, {R('operating_profit')} AS operating_profit, {R('operating_margin_pct')} AS operating_margin_pct,
  {pct('payroll_cost', 'revenue')} AS payroll_pct_of_revenue, {pct('marketing_spend', 'revenue')} AS marketing_pct_of_revenue, {pct('operating_expenses', 'revenue')} AS opex_pct_of_revenue, {R('revenue / NULLIF(headcount, 0)')} AS revenue_per_head FROM v_monthly_pnl ORDER BY month_start""",
    "q20_opex_by_category_trend": f"""WITH e AS (SELECT month, expense_category, CAST(amount AS DOUBLE) AS amount, CAST(SUM(amount) OVER (PARTITION BY month) AS DOUBLE) AS month_total FROM fact_operating_expenses)
SELECT month, expense_category, {R('amount')} AS amount, {R('LAG(amount, 12) OVER w')} AS amount_ly, {growth('amount', 12)} AS yoy_growth_pct, {pct('amount', 'month_total')} AS pct_of_month_opex FROM e WINDOW w AS (PARTITION BY expense_category ORDER BY month) ORDER BY expense_category, month""",
    "q21_marketing_efficiency": f"""WITH s AS (SELECT month, region, {S('spend')} AS spend FROM fact_marketing_spend GROUP BY 1, 2), r AS (SELECT month_start, region, {S('revenue')} AS revenue FROM fact_transactions GROUP BY 1, 2),
j AS (SELECT s.month AS month, s.region AS region, spend, revenue FROM s JOIN r ON s.month = r.month_start AND s.region = r.region)
SELECT month, region, {R('spend')} AS marketing_spend, {R('revenue')} AS revenue, {R('LEAD(revenue) OVER w')} AS next_month_revenue, {R('revenue / NULLIF(spend, 0)')} AS revenue_per_marketing_dollar, {pct('spend', 'revenue')} AS marketing_pct_of_revenue, {growth('spend', 1)} AS spend_mom_pct, {growth('revenue', 1)} AS revenue_mom_pct FROM j WINDOW w AS (PARTITION BY region ORDER BY month) ORDER BY region, month""",
    "q22_budget_variance": f"""WITH r AS (SELECT month_start, region, SUM(revenue) AS revenue, SUM(profit) AS profit FROM fact_transactions GROUP BY 1, 2),
j AS (SELECT b.month AS month, b.region AS region, revenue, revenue_target, CAST(revenue AS DOUBLE) AS r, CAST(revenue_target AS DOUBLE) AS rt, CAST(profit AS DOUBLE) AS p, CAST(profit_target AS DOUBLE) AS pt FROM fact_budget b JOIN r ON b.month = r.month_start AND b.region = r.region)
SELECT month, region, r AS actual_revenue, rt AS target_revenue, {R('r - rt')} AS revenue_variance, {pct('r - rt', 'rt')} AS revenue_variance_pct, p AS actual_profit, pt AS target_profit, {pct('p - pt', 'pt')} AS profit_variance_pct,
  CASE WHEN revenue >= revenue_target * CAST(1.05 AS DECIMAL(3,2)) THEN 'Beat' WHEN revenue >= revenue_target THEN 'Met' WHEN revenue >= revenue_target * CAST(0.90 AS DECIMAL(3,2)) THEN 'Near miss' ELSE 'Missed' END AS attainment FROM j ORDER BY month, region""",
    "q23_largest_monthly_declines": f"""WITH m AS (SELECT year_month, revenue, LAG(revenue) OVER (ORDER BY month_start) AS previous FROM v_monthly_revenue)
SELECT year_month, {R('previous')} AS previous_month_revenue, {R('revenue')} AS revenue, {R('revenue - previous')} AS revenue_change, {pct('revenue - previous', 'previous')} AS change_pct FROM m WHERE previous IS NOT NULL ORDER BY m.revenue - previous, year_month LIMIT 10""",
    "q24_loss_making_transactions": f"""WITH l AS (SELECT year_month, product_category, COUNT(*) AS n, SUM(revenue) AS revenue, SUM(profit) AS profit, SUM(CAST(profit_margin_pct AS DECIMAL(20,8))) AS margins, SUM(discount) AS discounts FROM fact_transactions WHERE is_loss_making = 1 GROUP BY 1, 2 HAVING COUNT(*) >= 5)
SELECT year_month, product_category, n AS loss_making_transactions, CAST(revenue AS DOUBLE) AS revenue_at_a_loss, CAST(profit AS DOUBLE) AS profit_impact, {R('CAST(margins AS DOUBLE) / n')} AS avg_margin_pct, {R('CAST(discounts AS DOUBLE) * 100 / n')} AS avg_discount_pct FROM l ORDER BY profit, year_month, product_category LIMIT 25""",
    "q25_payment_type_mix": f"""WITH p AS ({fact('payment_type')}) SELECT payment_type, transactions, {R('revenue')} AS revenue, {R('profit')} AS profit, {MARGIN}, {AOV}, {pct('revenue', 'SUM(revenue) OVER ()')} AS pct_of_revenue FROM p ORDER BY revenue DESC, payment_type""",
    "q26_receivables_aging": f"""WITH a AS (SELECT aging_bucket, COUNT(*) AS invoices, {S('invoice_amount')} AS balance, CAST(SUM(days_overdue) AS DOUBLE) AS overdue FROM fact_accounts_receivable GROUP BY 1)
SELECT aging_bucket, invoices, {R('balance')} AS balance, {R('balance / invoices')} AS avg_invoice, {R('overdue / invoices', 1)} AS avg_days_overdue, {pct('balance', 'SUM(balance) OVER ()')} AS pct_of_total FROM a ORDER BY aging_bucket""",
    "q27_collections_performance": f"""WITH s AS (SELECT customer_segment, COUNT(*) AS invoices, {S('invoice_amount')} AS amount, CAST(SUM(days_to_pay) AS DOUBLE) AS days, {N("CASE WHEN payment_status = 'Paid late' THEN 1 ELSE 0 END")} AS late FROM fact_accounts_receivable r JOIN dim_customer c ON r.customer_id = c.customer_id WHERE days_to_pay IS NOT NULL GROUP BY 1)
SELECT customer_segment, invoices AS invoices_settled, {R('days / invoices', 1)} AS avg_days_to_pay, {R('amount')} AS settled_value, late AS paid_late, {pct('late', 'invoices')} AS late_payment_rate_pct FROM s ORDER BY avg_days_to_pay DESC, customer_segment""",
    "q28_monthly_kpi_scorecard": f"""WITH k AS (SELECT m.*, operating_profit, operating_margin_pct, marketing_spend, headcount FROM v_monthly_revenue m LEFT JOIN v_monthly_pnl p ON m.month_start = p.month_start)
SELECT {MONTH}, {R('revenue')} AS revenue, {R('cost')} AS cost, {R('profit')} AS gross_profit, {R('profit_margin_pct')} AS gross_margin_pct, {COST}, {R('discount_rate_pct')} AS discount_rate_pct, transactions, active_customers, units_sold, {R('avg_transaction_value')} AS avg_order_value, {R('revenue / NULLIF(active_customers, 0)')} AS revenue_per_customer,
  {growth('revenue', 1)} AS revenue_mom_pct, {growth('revenue', 12)} AS revenue_yoy_pct, {growth('profit', 12)} AS profit_yoy_pct, {ma3('revenue')} AS revenue_3mo_ma, {R('operating_profit')} AS operating_profit, {R('operating_margin_pct')} AS operating_margin_pct, {R('marketing_spend')} AS marketing_spend, headcount FROM k WINDOW w AS (ORDER BY month_start) ORDER BY month_start""",
    "q29_data_quality_summary": f"""WITH y AS (SELECT year, COUNT(*) AS transactions, {N('had_reconciliation_error')} AS errors, {N('1 - is_customer_attributed')} AS unattributed, {N('is_loss_making')} AS losses, {S('CASE WHEN is_customer_attributed = 0 THEN revenue ELSE 0 END')} AS lost FROM fact_transactions GROUP BY year)
SELECT year, transactions, errors AS rows_with_reconciliation_error, {pct('errors', 'transactions')} AS pct_with_error, unattributed AS unattributed_rows, losses AS loss_making_rows, {R('lost')} AS unattributed_revenue FROM y ORDER BY year""",
}

DIMENSIONS = {"region": "region", "category": "product_category", "segment": "customer_segment", "payment": "payment_type"}


def where(start: str | None = None, end: str | None = None, regions=(), categories=(), segments=()) -> tuple[str, dict[str, str]]:
    """A conjunction of the filters given (a date range, any of the values of each dimension) and the values to bind to its :names."""
    out, args = [], {}
    for name, value, test in (("start", start, ">="), ("end", end, "<=")):
        if value:
            # The month as well, by which the written ledger is partitioned.
            out.append(f"transaction_date {test} CAST(:f_{name} AS DATE) AND year_month {test} :f_{name}_month")
            args |= {f"f_{name}": str(value), f"f_{name}_month": str(value)[:7]}
    for column, values in (("region", regions), ("product_category", categories), ("customer_segment", segments)):
        names = {f"f_{column}_{i}": str(v) for i, v in enumerate(values)}
        if names:
            out.append(f"{column} IN ({', '.join(':' + n for n in names)})")
            args |= names
    return " AND ".join(out) or "1 = 1", args


def breakdown(dimension: str, condition: str = "1 = 1") -> str:
    """Totals by a whitelisted dimension."""
    if dimension not in DIMENSIONS:
        raise KeyError(f"unknown dimension {dimension}; one of {sorted(DIMENSIONS)}")
    return f"""WITH b AS ({fact(DIMENSIONS[dimension], condition, CUSTOMERS)})
SELECT {DIMENSIONS[dimension]} AS label, transactions, customers, units_sold, revenue, profit, {MARGIN}, {DISCOUNT}, {pct('revenue', 'SUM(revenue) OVER ()')} AS pct_of_revenue, {pct('profit', 'SUM(profit) OVER ()')} AS pct_of_profit FROM b"""


def filtered(condition: str, top: int = 30) -> dict[str, str]:
    """The dashboard's questions over the transactions that meet a condition."""
    f = f"FROM fact_transactions WHERE {condition}"
    monthly = f"SELECT year_month, month_start, {CORE}, COUNT(DISTINCT customer_id) AS customers {f} GROUP BY 1, 2"
    customers = f"SELECT customer_id, customer_segment, region, COUNT(*) AS transactions, SUM(revenue) AS revenue {f} AND is_customer_attributed = 1 GROUP BY 1, 2, 3"
    per_customer = f"SELECT customer_id, COUNT(*) AS orders, SUM(revenue) AS revenue {f} AND is_customer_attributed = 1 GROUP BY 1"
    return {
        "meta": f"SELECT MIN(transaction_date) AS first_date, MAX(transaction_date) AS last_date, COUNT(DISTINCT region) AS regions, COUNT(DISTINCT product_category) AS categories, COUNT(DISTINCT customer_segment) AS segments, COUNT(DISTINCT payment_type) AS payments, COUNT(*) AS transactions {f}",
        "kpis": f"""WITH m AS ({monthly}), n AS (SELECT m.*, ROW_NUMBER() OVER (ORDER BY month_start DESC) AS back, COUNT(*) OVER () AS months FROM m),
t AS (SELECT CASE WHEN back <= 12 THEN 'ttm' ELSE 'prior_ttm' END AS period, SUM(transactions) AS transactions, ROUND(SUM(revenue), 2) AS revenue, ROUND(SUM(profit), 2) AS profit, MAX(months) AS months FROM n WHERE back <= 24 GROUP BY 1)
SELECT period, CAST(transactions AS BIGINT) AS transactions, revenue, profit, {pct('profit', 'revenue')} AS margin_pct, CASE WHEN period = 'ttm' THEN months >= 13 ELSE months >= 24 END AS complete FROM t""",
        "monthly": f"WITH m AS ({monthly}) SELECT year_month, transactions, units_sold, customers, revenue, cost, profit, {growth('revenue', 1)} AS mom_pct, {growth('revenue', 12)} AS yoy_pct, {ma3('revenue')} AS revenue_ma3, ROUND(SUM(revenue) OVER (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS revenue_to_date FROM m WINDOW w AS (ORDER BY month_start)",
        "yearly": f"WITH y AS (SELECT year, {CORE}, COUNT(DISTINCT customer_id) AS customers {f} GROUP BY year) SELECT year, transactions, units_sold, customers, revenue, cost, profit, {pct('profit', 'revenue')} AS margin_pct, {growth('revenue', 1)} AS revenue_growth_pct, {growth('profit', 1)} AS profit_growth_pct, {growth('transactions', 1)} AS volume_growth_pct FROM y WINDOW w AS (ORDER BY year)",
        "region_monthly": f"SELECT region, year_month, COUNT(*) AS transactions, {S('revenue')} AS revenue, {S('profit')} AS profit {f} GROUP BY 1, 2",
        "breakdown_region": breakdown("region", condition),
        "breakdown_category": breakdown("category", condition),
        "breakdown_segment": breakdown("segment", condition),
        "breakdown_payment": breakdown("payment", condition),
        "discount_bands": f"WITH b AS (SELECT {BAND} AS discount_band, {CORE}, {N('is_loss_making')} AS loss_making {f} GROUP BY 1) SELECT SUBSTR(discount_band, 4) AS band, RANK() OVER (ORDER BY discount_band) AS band_order, transactions, revenue, profit, {pct('profit', 'revenue')} AS margin_pct, {pct('loss_making', 'transactions')} AS loss_making_pct, {pct('transactions', 'SUM(transactions) OVER ()')} AS share_pct FROM b",
        "products": f"""WITH p AS ({fact('product_id, product_name, product_category', condition)}), q AS (SELECT p.*, profit / NULLIF(revenue, 0) AS margin FROM p), {ordered('r', 'q', 'revenue', 'c.product_id', down=False)}, {ordered('m', 'r', 'margin', 'c.product_id', down=False)}
SELECT product_id, product_name, product_category, units_sold, revenue, profit, {MARGIN}, {DISCOUNT}, {R('(r_rank - 1) * 100.0E0 / GREATEST(r_n - 1, 1)', 4)} AS revenue_pctile, {R('(m_rank - 1) * 100.0E0 / GREATEST(m_n - 1, 1)', 4)} AS margin_pctile FROM m""",
        "customers_top": f"""WITH c AS ({customers}), t AS (SELECT * FROM c ORDER BY revenue DESC, customer_id, region, customer_segment LIMIT {top}), g AS (SELECT SUM(revenue) AS total FROM c),
n AS (SELECT t.*, ROW_NUMBER() OVER w AS position, SUM(revenue) OVER (ORDER BY revenue DESC, customer_id, region, customer_segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM t WINDOW w AS (ORDER BY revenue DESC, customer_id, region, customer_segment))
SELECT position, customer_id, customer_segment, region, transactions, CAST(revenue AS DOUBLE) AS revenue, {pct('CAST(revenue AS DOUBLE)', 'CAST(total AS DOUBLE)')} AS share_pct, {pct('CAST(running AS DOUBLE)', 'CAST(total AS DOUBLE)')} AS cumulative_pct FROM n CROSS JOIN g""",
        "deciles": f"""WITH v AS ({per_customer}), {ordered('c', 'v', 'revenue', 'c.customer_id')}, d AS (SELECT {tile('c_at', 'c_n')} AS decile, COUNT(*) AS customers, SUM(revenue) AS revenue FROM c GROUP BY 1)
SELECT decile, customers, CAST(revenue AS DOUBLE) AS revenue, {pct('CAST(revenue AS DOUBLE)', 'CAST(SUM(revenue) OVER () AS DOUBLE)')} AS share_pct, {pct('CAST(SUM(revenue) OVER (ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)', 'CAST(SUM(revenue) OVER () AS DOUBLE)')} AS cumulative_pct FROM d""",
        "order_bands": f"WITH c AS ({per_customer}), b AS (SELECT REPLACE({ORDERS}, ' orders', '') AS band, COUNT(*) AS customers, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM c GROUP BY 1) SELECT band, customers, revenue, {pct('customers', 'SUM(customers) OVER ()')} AS customer_share_pct, {pct('revenue', 'SUM(revenue) OVER ()')} AS revenue_share_pct FROM b",
        "lorenz": f"""WITH v AS ({per_customer}), {ordered('c', 'v', 'revenue', 'c.customer_id', add=True)}
SELECT c_at AS position, {R('c_at * 100.0E0 / c_n', 4)} AS customer_pct, {R('CAST(c_sum AS DOUBLE) * 100 / CAST(c_total AS DOUBLE)', 4)} AS revenue_pct FROM c WHERE c_at % GREATEST(1, CAST(FLOOR(c_n / 200.0E0) AS BIGINT)) = 0 OR c_at = c_n""",
        "customers_summary": f"SELECT COUNT(*) AS transactions, {S('revenue')} AS revenue, {S('CASE WHEN is_customer_attributed = 1 THEN revenue END')} AS attributed_revenue, {S('CASE WHEN is_customer_attributed = 0 THEN revenue END')} AS unattributed_revenue, {N('1 - is_customer_attributed')} AS unattributed_transactions {f}",
        "health": f"SELECT COUNT(*) AS rows_in_fact {f}",
    }


FILTER, FILTER_ARGS = where(start="1996-01-01", end="1999-12-31", regions=("ASIA", "EUROPE"), segments=("BUILDING", "MACHINERY"))
DASHBOARD = {f"h_{k}": v for k, v in filtered("1 = 1").items()} | {f"hf_{k}": v for k, v in filtered(FILTER).items()}
DASHBOARD["f09_months"] = fact("year_month", "year_month IN (:m_0, :m_1, :m_2)")
BOUND = {name: FILTER_ARGS for name in DASHBOARD if name.startswith("hf_")} | {"f09_months": {"m_0": "1996-01", "m_1": "1996-02", "m_2": "1999-12"}}

INTEGRITY = {
    "j07_orphan_products": "SELECT COUNT(*) AS orphans FROM lineitem LEFT JOIN dim_product ON l_partkey = product_id WHERE product_id IS NULL",
    "j07_orphan_dates": "SELECT COUNT(*) AS orphans FROM base_lines LEFT JOIN dim_date ON transaction_date = date_key WHERE date_key IS NULL",
    "j07_orphan_customers": "SELECT COUNT(*) AS orphans FROM orders LEFT JOIN dim_customer ON o_custkey = customer_id WHERE customer_id IS NULL",
}

DERIVED = {
    "x01_margin_trend": "SELECT ROUND(12 * REGR_SLOPE(profit_margin_pct, i), 6) AS points_a_year, ROUND(REGR_R2(profit_margin_pct, i), 6) AS r2 FROM (SELECT profit_margin_pct, CAST(ROW_NUMBER() OVER (ORDER BY month_start) - 1 AS DOUBLE) AS i FROM v_monthly_revenue) t",
    "x03_category_shares": f"WITH c AS (SELECT product_category, {S('revenue')} AS revenue, {S('profit')} AS profit FROM fact_transactions GROUP BY 1) SELECT product_category, {pct('revenue', 'SUM(revenue) OVER ()')} AS revenue_share_pct, {pct('profit', 'SUM(profit) OVER ()')} AS profit_share_pct FROM c",
    "x07_cost_structure_latest_year": f"WITH p AS (SELECT year(month_start) AS y, {money('revenue')} AS revenue, {money('cogs')} AS cogs, {money('operating_expenses')} AS opex, {money('payroll_cost')} AS payroll, {money('marketing_spend')} AS marketing FROM v_monthly_pnl) SELECT {pct(S('cogs'), S('revenue'))} AS cost_pct, {pct(S('opex'), S('revenue'))} AS opex_pct, {pct(S('payroll'), S('revenue'))} AS payroll_pct, {pct(S('marketing'), S('revenue'))} AS marketing_pct FROM p WHERE y = (SELECT MAX(y) FROM p)",
    "x08_six_band_discounts": f"SELECT CASE WHEN discount = 0 THEN '0' WHEN discount <= 0.05 THEN '0-5' WHEN discount <= 0.10 THEN '5-10' WHEN discount <= 0.20 THEN '10-20' WHEN discount <= 0.30 THEN '20-30' ELSE '30+' END AS band, COUNT(*) AS transactions, {S('revenue')} AS revenue, {pct(S('profit'), S('revenue'))} AS margin_pct FROM fact_transactions GROUP BY 1",
    "x09_category_margin_change": f"WITH m AS (SELECT product_category, year, {S('profit')} * 100.0E0 / NULLIF({S('revenue')}, 0) AS margin FROM fact_transactions GROUP BY 1, 2), e AS (SELECT MIN(year) AS lo, MAX(year) AS hi FROM m) SELECT product_category, ROUND(MAX(CASE WHEN year = lo THEN margin END), 4) AS first_margin, ROUND(MAX(CASE WHEN year = hi THEN margin END), 4) AS last_margin, ROUND(MAX(CASE WHEN year = hi THEN margin END) - MAX(CASE WHEN year = lo THEN margin END), 4) AS change FROM m CROSS JOIN e GROUP BY 1",
    "x02_share_of_top_fifth": f"""WITH v AS (SELECT customer_id, {money('revenue')} AS revenue FROM v_customer_summary), {ordered('c', 'v', 'revenue', 'c.customer_id', add=True)},
p AS (SELECT c_at, c_at * 100.0E0 / c_n AS x, CAST(c_sum AS DOUBLE) * 100 / CAST(c_total AS DOUBLE) AS y FROM c), b AS (SELECT COALESCE(MAX(CASE WHEN x <= 20 THEN x END), 0) AS x0, COALESCE(MAX(CASE WHEN x <= 20 THEN y END), 0) AS y0, MIN(CASE WHEN x > 20 THEN x END) AS x1, MIN(CASE WHEN x > 20 THEN y END) AS y1 FROM p)
SELECT {R('y0 + (20 - x0) * (y1 - y0) / (x1 - x0)', 4)} AS revenue_share_pct FROM b""",
    "x10_top_shares": f"""WITH v AS (SELECT customer_id, {money('revenue')} AS revenue FROM v_customer_summary), {ordered('c', 'v', 'revenue', 'c.customer_id')}
SELECT {pct(S('CASE WHEN c_at <= 10 THEN revenue END'), S('revenue'))} AS top10_share_pct, {pct(S('CASE WHEN c_at <= FLOOR(c_n * 0.2E0) THEN revenue END'), S('revenue'))} AS top_fifth_share_pct FROM c""",
    "x11_investigation_list": f"WITH m AS (SELECT MEDIAN(revenue) AS revenue_median, MEDIAN(profit_margin_pct) AS margin_median FROM v_product_summary) SELECT product_id, revenue, {R('profit_margin_pct')} AS profit_margin_pct FROM v_product_summary CROSS JOIN m WHERE revenue > revenue_median AND profit_margin_pct < margin_median",
    "x12_product_quadrants": f"WITH m AS (SELECT MEDIAN(units_sold) AS units_median, MEDIAN(profit_margin_pct) AS margin_median FROM v_product_summary), q AS (SELECT CASE WHEN units_sold >= units_median AND profit_margin_pct >= margin_median THEN 'Star' WHEN units_sold >= units_median THEN 'Fix' WHEN profit_margin_pct >= margin_median THEN 'Grow' ELSE 'Review' END AS quadrant, {money('revenue')} AS revenue FROM v_product_summary CROSS JOIN m), s AS (SELECT quadrant, COUNT(*) AS products, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM q GROUP BY 1) SELECT quadrant, products, revenue, {pct('revenue', 'SUM(revenue) OVER ()')} AS share_pct FROM s",
    "x13_discount_heavy_floor": f"WITH m AS (SELECT 0.25E0 * MEDIAN(units_sold) AS floor_units FROM v_product_summary) SELECT product_id, units_sold, {R('p.discount_rate_pct', 4)} AS discount_pct FROM v_product_summary p CROSS JOIN m WHERE units_sold >= floor_units ORDER BY p.discount_rate_pct DESC, product_id LIMIT 20",
    "x14_top_products": " UNION ALL ".join(f"SELECT * FROM (SELECT '{label}' AS list, product_id, units_sold, revenue, profit, {R('profit_margin_pct')} AS margin_pct FROM v_product_summary p ORDER BY p.{by}, product_id LIMIT 15) t" for label, by in (("units", "units_sold DESC"), ("revenue", "revenue DESC"), ("profit", "profit DESC"), ("worst margin", "profit_margin_pct NULLS LAST"))),
    "x15_margin_uplift": f"""WITH {ordered('r', 'v_product_summary', 'revenue', 'c.product_id', down=False)}, {ordered('m', 'r', 'profit_margin_pct', 'c.product_id', down=False)},
f AS (SELECT {money('revenue')} AS revenue, CASE WHEN (r_rank - 1) >= 0.5E0 * (r_n - 1) AND (m_rank - 1) <= 0.25E0 * (m_n - 1) THEN 1 ELSE 0 END AS flagged FROM m) SELECT flagged = 1 AS needs_investigation, COUNT(*) AS products, {S('revenue')} AS revenue, {R(S('revenue') + ' * 0.01E0')} AS uplift_per_margin_point FROM f GROUP BY 1""",
    "x16_ttm_changes": f"""WITH n AS (SELECT v.*, ROW_NUMBER() OVER (ORDER BY month_start DESC) AS back, COUNT(*) OVER () AS months FROM v_monthly_revenue v), t AS (SELECT MAX(months) AS months, {S("CASE WHEN back <= 12 THEN " + money('revenue') + " END")} AS r1, {S("CASE WHEN back BETWEEN 13 AND 24 THEN " + money('revenue') + " END")} AS r0, {S("CASE WHEN back <= 12 THEN " + money('profit') + " END")} AS p1, {S("CASE WHEN back BETWEEN 13 AND 24 THEN " + money('profit') + " END")} AS p0 FROM n)
SELECT r1 AS revenue_ttm, r0 AS revenue_prior_ttm, {pct('r1 - r0', 'r0')} AS revenue_change_pct, {pct('p1 - p0', 'ABS(p0)')} AS profit_change_pct, {R('p1 * 100.0E0 / NULLIF(r1, 0) - p0 * 100.0E0 / NULLIF(r0, 0)')} AS margin_change_pp, months >= 24 AS complete FROM t""",
    "x04_revenue_histogram": f"""WITH v AS (SELECT CAST(revenue AS DOUBLE) AS x FROM fact_transactions WHERE revenue > 0), q AS (SELECT PERCENTILE_CONT(0.98) WITHIN GROUP (ORDER BY x) AS hi, MIN(x) AS lo FROM v),
b AS (SELECT CAST(LEAST(79, FLOOR((x - lo) * 80 / (hi - lo))) AS BIGINT) AS bin, COUNT(*) AS transactions, MAX(lo) AS lo, MAX(hi) AS hi FROM v CROSS JOIN q WHERE x <= hi GROUP BY 1) SELECT bin, {R('lo + bin * (hi - lo) / 80', 4)} AS from_value, transactions FROM b""",
    "a20_log_histogram": "SELECT CAST(FLOOR(10 * LOG10(CAST(revenue AS DOUBLE))) AS BIGINT) AS tenth_of_decade, COUNT(*) AS transactions FROM fact_transactions WHERE revenue > 0 GROUP BY 1",
    "a14_skewness": f"""WITH m AS (SELECT region, COUNT(*) AS n, {S('revenue')} / COUNT(*) AS mean FROM fact_transactions GROUP BY 1), d AS (SELECT f.region, n, CAST(revenue AS DOUBLE) - mean AS x FROM fact_transactions f JOIN m ON m.region = f.region)
SELECT region, MAX(n) AS n, ROUND(AVG(x * x * x) / POWER(AVG(x * x), 1.5E0), 6) AS skewness FROM d GROUP BY region""",
    "j10_monthly_marketing": f"WITH s AS (SELECT month, {S('spend')} AS marketing_spend FROM fact_marketing_spend GROUP BY 1) SELECT month_start, revenue, marketing_spend, LEAD(revenue) OVER (ORDER BY month_start) AS revenue_next_month FROM v_monthly_revenue LEFT JOIN s ON s.month = month_start",
    "j11_marketing_ratio": f"WITH s AS (SELECT month, {S('spend')} AS spend FROM fact_marketing_spend GROUP BY 1) SELECT month_start, {R('spend * 100 / NULLIF(revenue, 0)', 4)} AS spend_pct_of_revenue FROM v_monthly_revenue JOIN s ON s.month = month_start",
    "o07_weekdays_in_order": f"WITH o AS (SELECT * FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) v(place, day)), t AS (SELECT day_of_week, COUNT(*) AS transactions, {S('revenue')} AS revenue FROM fact_transactions GROUP BY 1) SELECT CAST(place AS BIGINT) AS place, day AS day_of_week, COALESCE(transactions, 0) AS transactions, COALESCE(revenue, 0) AS revenue FROM o LEFT JOIN t ON day = day_of_week ORDER BY place",
    "o08_capped_rows": f"WITH r AS (SELECT region, year_month, {S('revenue')} AS revenue FROM fact_transactions GROUP BY 1, 2), c AS (SELECT COUNT(*) AS n FROM (SELECT 1 AS one FROM r LIMIT 101) t) SELECT region, year_month, revenue, n > 100 AS truncated FROM r CROSS JOIN c ORDER BY region, year_month LIMIT 100",
    "p03_unit_margin": f"SELECT product_category, COUNT(*) AS transactions, {R('AVG(CAST(unit_margin AS DECIMAL(20,6)))', 4)} AS avg_unit_margin, {R('AVG(CAST(cost_to_revenue_ratio AS DECIMAL(20,8)))', 4)} AS avg_cost_ratio FROM fact_transactions GROUP BY 1",
    "x17_repeat_rate": f"WITH c AS (SELECT customer_id, COUNT(*) AS orders FROM fact_transactions WHERE is_customer_attributed = 1 GROUP BY 1) SELECT COUNT(*) AS customers, ROUND(100.0E0 - SUM(CASE WHEN orders = 1 THEN 1 ELSE 0 END) * 100.0E0 / COUNT(*), 4) AS repeat_rate_pct FROM c",
}

SQL = {**VIEWS, **NAMED, **DASHBOARD, **INTEGRITY, **DERIVED}
