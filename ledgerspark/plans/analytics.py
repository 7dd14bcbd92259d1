"""Indicators, series, anomaly rules and test statistics, as SQL over the star schema.

Everything that grows with the data is an aggregate, a join or a window after aggregation. Closed-form p-values are
the business of functions/dist.py, which works on the single rows that these statistics return.
"""

from __future__ import annotations

from .library import N, R, S, growth, pct

F_ = "fact_transactions"
D2 = "CAST(ROUND({0}, 2) AS DECIMAL(18,2))"

# One row for each period: the core indicators; attributed customers only where customers are counted.
ACTIVE = "COUNT(DISTINCT CASE WHEN is_customer_attributed = 1 THEN customer_id END)"
SUMS = f"""{S('revenue')} AS revenue, {S('cost')} AS cost, {S('profit')} AS gross_profit, {pct(S('profit'), S('revenue'))} AS gross_margin_pct, {pct(S('cost'), S('revenue'))} AS cost_to_revenue_pct,
 {pct(S('gross_revenue') + ' - ' + S('revenue'), S('gross_revenue'))} AS discount_rate_pct, COUNT(*) AS transactions, {N('quantity')} AS units_sold, {ACTIVE} AS active_customers,
 {R(S('revenue') + ' / COUNT(*)')} AS avg_order_value, {R(S('revenue') + ' / NULLIF(' + ACTIVE + ', 0)')} AS revenue_per_customer, {pct('SUM(is_loss_making)', 'COUNT(*)')} AS loss_making_pct"""
CORE = f"SELECT year, {SUMS} FROM {F_} GROUP BY year"
PERIOD_CUSTOMERS = f"SELECT DISTINCT {{p}} AS period, customer_id FROM {F_} WHERE is_customer_attributed = 1"
#: The indicators' names, units, whether more is better, and categories.
SPECS = (
    ("revenue", "Total Revenue", "currency", 1, "Revenue"), ("cost", "Total Cost", "currency", 0, "Cost"), ("gross_profit", "Gross Profit", "currency", 1, "Profitability"),
    ("gross_margin_pct", "Gross Margin", "percent", 1, "Profitability"), ("cost_to_revenue_pct", "Cost-to-Revenue Ratio", "percent", 0, "Cost"), ("discount_rate_pct", "Discount Rate", "percent", 0, "Revenue"),
    ("transactions", "Transactions", "count", 1, "Volume"), ("units_sold", "Units Sold", "count", 1, "Volume"), ("active_customers", "Active Customers", "count", 1, "Customers"),
    ("avg_order_value", "Average Order Value", "currency", 1, "Revenue"), ("revenue_per_customer", "Revenue per Customer", "currency", 1, "Customers"), ("top10_customer_share_pct", "Top 10 Customer Share", "percent", 0, "Customers"),
    ("loss_making_pct", "Loss-Making Transactions", "percent", 0, "Profitability"), ("new_customers", "New Customers", "count", 1, "Customers"), ("retention_pct", "Customer Retention Rate", "percent", 1, "Customers"),
    ("receivables_balance", "Receivables Balance", "currency", 0, "Cash"), ("dso_days", "Days Sales Outstanding", "days", 0, "Cash"), ("avg_days_to_pay", "Average Days to Pay", "days", 0, "Cash"),
)


def receivables(p: str) -> str:
    """CTEs `p` (periods in order, with their ends) and `cash` (balance, days of sales outstanding, days to pay at each period's end).

    An invoice adds to the balance in the period that issues it and leaves it in the one that pays it; the balance is the
    running sum over the periods, so no invoice meets every period.
    """
    return f"""p AS (SELECT {p} AS period, MIN(transaction_date) AS starts, MAX(transaction_date) AS ends, {S('revenue')} AS revenue, ROW_NUMBER() OVER (ORDER BY {p}) AS i FROM {F_} GROUP BY {p}),
days AS (SELECT i, COUNT(*) AS days FROM p JOIN dim_date d ON d.{p} = p.period WHERE date_key BETWEEN starts AND ends GROUP BY i),
ar AS (SELECT invoice_amount, days_to_pay, pi.i AS own, pi.i + CASE WHEN invoice_date > pi.ends THEN 1 ELSE 0 END AS issued, pp.i + CASE WHEN paid_date > pp.ends THEN 1 ELSE 0 END AS paid, CASE WHEN invoice_date >= pi.starts AND paid_date <= pi.ends THEN 1 ELSE 0 END AS within
  FROM fact_accounts_receivable r JOIN dim_date di ON di.date_key = invoice_date JOIN p pi ON pi.period = di.{p} LEFT JOIN dim_date dp ON dp.date_key = paid_date LEFT JOIN p pp ON pp.period = dp.{p}),
moved AS (SELECT i, SUM(amount) AS amount FROM (SELECT issued AS i, invoice_amount AS amount FROM ar UNION ALL SELECT GREATEST(paid, issued), -invoice_amount FROM ar WHERE paid IS NOT NULL) t GROUP BY i),
speed AS (SELECT own AS i, CAST(SUM(days_to_pay) AS DOUBLE) / COUNT(*) AS avg_days_to_pay FROM ar WHERE within = 1 GROUP BY own),
cash AS (SELECT p.i, p.period, p.revenue, CAST(SUM(COALESCE(amount, 0)) OVER (ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS receivables_balance, days, {R('avg_days_to_pay')} AS avg_days_to_pay
  FROM p JOIN days ON days.i = p.i LEFT JOIN moved ON moved.i = p.i LEFT JOIN speed ON speed.i = p.i)"""


def scorecard(p: str) -> str:
    """The latest period's 18 indicators beside those of the period before: one pass over the ledger by period, then a pivot to rows."""
    values = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m, *_ in SPECS)
    specs = ", ".join(f"({i}, '{m}', '{name}', '{unit}', {more}, '{category}')" for i, (m, name, unit, more, category) in enumerate(SPECS))
    return f"""WITH {receivables(p)}, k AS (SELECT {p} AS period, {SUMS} FROM {F_} GROUP BY {p}),
c AS (SELECT {p} AS period, customer_id, SUM(revenue) AS revenue FROM {F_} WHERE is_customer_attributed = 1 GROUP BY 1, 2), pc AS (SELECT i, customer_id, c.revenue, LAG(i) OVER (PARTITION BY customer_id ORDER BY i) AS last FROM c JOIN p ON p.period = c.period),
t10 AS (SELECT i, SUM(revenue) AS top10 FROM (SELECT i, c.revenue, ROW_NUMBER() OVER (PARTITION BY i ORDER BY c.revenue DESC, customer_id) AS n FROM c JOIN p ON p.period = c.period) r WHERE n <= 10 GROUP BY i),
top AS (SELECT pc.i, {pct('CAST(MAX(top10) AS DOUBLE)', S('revenue'))} AS top10_customer_share_pct, {N('CASE WHEN last IS NULL THEN 1 ELSE 0 END')} AS new_customers, {N('CASE WHEN last = pc.i - 1 THEN 1 ELSE 0 END')} AS retained, COUNT(*) AS active FROM pc JOIN t10 ON t10.i = pc.i GROUP BY pc.i),
m AS (SELECT cash.i AS i, k.*, top10_customer_share_pct, new_customers, {pct('retained', 'LAG(active) OVER (ORDER BY cash.i)')} AS retention_pct, receivables_balance, {R('receivables_balance / NULLIF(cash.revenue, 0) * days')} AS dso_days, avg_days_to_pay FROM k JOIN cash ON cash.period = k.period JOIN top ON top.i = cash.i),
u AS (SELECT i, metric, value FROM (SELECT i, {values} FROM m) w UNPIVOT (value FOR metric IN ({', '.join(m for m, *_ in SPECS)}))),
s AS (SELECT * FROM (VALUES {specs}) s(place, metric, name, unit, higher_is_better, category)), l AS (SELECT MAX(i) AS i FROM p),
v AS (SELECT place, name, unit, higher_is_better, category, MAX(CASE WHEN u.i = l.i THEN value END) AS value, MAX(CASE WHEN u.i = l.i - 1 THEN value END) AS prior_value FROM s JOIN u ON u.metric = s.metric CROSS JOIN l WHERE u.i >= l.i - 1 GROUP BY 1, 2, 3, 4, 5)
SELECT CAST(place AS BIGINT) AS place, name, unit, category, higher_is_better = 1 AS higher_is_better, value, prior_value, {R('value - prior_value', 4)} AS change, {R('(value - prior_value) / NULLIF(ABS(prior_value), 0) * 100', 4)} AS change_pct,
 CASE WHEN value - prior_value > 0 THEN 'up' WHEN value - prior_value < 0 THEN 'down' WHEN value = prior_value THEN 'flat' ELSE 'n/a' END AS direction, CASE WHEN value <> prior_value THEN (value > prior_value) = (higher_is_better = 1) END AS is_favourable FROM v ORDER BY place"""


KPI = {
    "k01_core_metrics": CORE,
    "k01_top10_customer_share": f"""WITH c AS (SELECT year, customer_id, SUM(revenue) AS revenue FROM {F_} WHERE is_customer_attributed = 1 GROUP BY 1, 2),
r AS (SELECT year, SUM(revenue) AS top10 FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY year ORDER BY revenue DESC, customer_id) AS n FROM c) o WHERE n <= 10 GROUP BY year)
SELECT c.year, {pct('CAST(MAX(top10) AS DOUBLE)', 'CAST(SUM(revenue) AS DOUBLE)')} AS top10_share_pct FROM c JOIN r ON r.year = c.year GROUP BY c.year""",
    "k02_retention": f"WITH p AS ({PERIOD_CUSTOMERS.format(p='year')}) SELECT a.period + 1 AS year, COUNT(*) AS before, COUNT(b.customer_id) AS retained, {pct('COUNT(b.customer_id)', 'COUNT(*)')} AS retention_pct FROM p a LEFT JOIN p b ON b.customer_id = a.customer_id AND b.period = a.period + 1 GROUP BY a.period",
    "k03_new_customers": f"WITH f AS (SELECT customer_id, MIN(year) AS year FROM {F_} WHERE is_customer_attributed = 1 GROUP BY 1) SELECT year, COUNT(*) AS new_customers FROM f GROUP BY year",
    "k04_receivable_days": f"WITH {receivables('year')} SELECT period AS year, revenue, receivables_balance AS balance, {R('receivables_balance / NULLIF(revenue, 0) * days', 4)} AS dso, avg_days_to_pay FROM cash",
    "k06_scorecard": scorecard("year"),
    "k07_monthly_scorecard": scorecard("year_month"),
    "k08_monthly_series": f"""WITH f AS (SELECT customer_id, MIN(month_start) AS first FROM {F_} WHERE is_customer_attributed = 1 GROUP BY 1), n AS (SELECT first, COUNT(*) AS new_customers FROM f GROUP BY 1), m AS (SELECT month_start, {SUMS} FROM {F_} GROUP BY 1)
SELECT m.*, COALESCE(new_customers, 0) AS new_customers, {growth('revenue', 1)} AS mom_pct, {growth('revenue', 12)} AS yoy_pct,
 CASE WHEN COUNT(*) OVER (ORDER BY month_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN {R('AVG(revenue) OVER (ORDER BY month_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} END AS revenue_ma3
FROM m LEFT JOIN n ON first = month_start WINDOW w AS (ORDER BY month_start)""",
}


def full(agg: str, n: int, x: str, w: str = "ORDER BY month_start") -> str:
    """An aggregate over n rows, null until there are n."""
    over = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({x}) {over} = {n} THEN ROUND({agg}({x}) {over}, 4) END"


SERIES = "SELECT month_start, year, quarter, month, gross_revenue, discount_amount, revenue, cost, profit, transactions, units_sold, active_customers, profit_margin_pct, discount_rate_pct, avg_transaction_value, CAST(ROW_NUMBER() OVER (ORDER BY month_start) - 1 AS DOUBLE) AS i FROM v_monthly_revenue"
TREND = """SELECT month, month_start, i, revenue, CASE WHEN COUNT(*) OVER c = 13 THEN (SUM(revenue) OVER c - 0.5E0 * LAG(revenue, 6) OVER w - 0.5E0 * LEAD(revenue, 6) OVER w) / 12 END AS trend FROM s
 WINDOW w AS (ORDER BY month_start), c AS (ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"""
TIME = {
    "ts01_monthly_spine": f"""WITH s AS ({SERIES}), g AS (SELECT s.*, revenue / NULLIF(LAG(revenue) OVER w, 0) - 1 AS mom, {full('AVG', 3, 'revenue')} AS ma3 FROM s WINDOW w AS (ORDER BY month_start))
SELECT month_start, i, gross_revenue, discount_amount, revenue, cost, profit, transactions, units_sold, active_customers, {R('profit_margin_pct', 4)} AS profit_margin_pct, {R('cost * 100 / NULLIF(revenue, 0)', 4)} AS cost_to_revenue_pct, {R('discount_rate_pct', 4)} AS discount_rate_pct, {R('avg_transaction_value', 4)} AS avg_order_value, {R('revenue / NULLIF(active_customers, 0)', 4)} AS revenue_per_customer,
 ma3, {full('AVG', 6, 'revenue')} AS ma6, {full('AVG', 12, 'revenue')} AS ma12, ROUND(revenue / ma3 - 1, 6) AS vs_ma3, ROUND(mom, 6) AS mom, ROUND(revenue / NULLIF(LAG(revenue, 12) OVER w, 0) - 1, 6) AS revenue_yoy, ROUND(profit / NULLIF(LAG(profit, 12) OVER w, 0) - 1, 6) AS profit_yoy, ROUND(transactions * 1.0E0 / NULLIF(LAG(transactions, 12) OVER w, 0) - 1, 6) AS transactions_yoy,
 {R('SUM(revenue) OVER (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cumulative, {full('STDDEV_SAMP', 6, 'mom')} AS volatility_6m FROM g WINDOW w AS (ORDER BY month_start)""",
    "ts02_log_trend": f"""WITH s AS ({SERIES}), f AS (SELECT REGR_SLOPE(LN(revenue), i) AS b, REGR_INTERCEPT(LN(revenue), i) AS a, REGR_R2(LN(revenue), i) AS r2, COUNT(*) AS n FROM s WHERE revenue > 0), y AS (SELECT year, SUM(CAST(ROUND(revenue, 2) AS DECIMAL(18,2))) AS revenue, COUNT(*) AS months FROM s GROUP BY year), e AS (SELECT MIN(year) AS lo, MAX(year) AS hi FROM y WHERE months = 12),
c AS (SELECT MAX(hi - lo) AS years, CAST(MAX(CASE WHEN year = lo THEN revenue END) AS DOUBLE) AS first, CAST(MAX(CASE WHEN year = hi THEN revenue END) AS DOUBLE) AS last FROM y CROSS JOIN e)
SELECT ROUND(b, 6) AS slope, ROUND(a, 6) AS intercept, ROUND(r2, 6) AS r2, ROUND(EXP(12 * b) - 1, 6) AS annual_growth, n AS months, ROUND(b * SQRT((n - 2) / NULLIF(1 - r2, 0)) * SQRT(r2) / NULLIF(ABS(b), 0) * SIGN(b), 4) AS t_statistic, ROUND(POWER(last / first, 1.0E0 / NULLIF(years, 0)) - 1, 6) AS cagr FROM f CROSS JOIN c""",
    "ts03_kendall_pairs": f"""WITH s AS ({SERIES}), k AS (SELECT COUNT(*) AS pairs, CAST(SUM(CASE WHEN b.revenue > a.revenue THEN 1 WHEN b.revenue < a.revenue THEN -1 ELSE 0 END) AS BIGINT) AS score FROM s a JOIN s b ON b.i > a.i), n AS (SELECT COUNT(*) AS n FROM s)
SELECT pairs, score AS concordant_minus_discordant, ROUND(score / CAST(pairs AS DOUBLE), 6) AS tau, ROUND(score / SQRT(n * (n - 1) * (2.0E0 * n + 5) / 18), 6) AS z FROM k CROSS JOIN n""",
    "ts04_classical_decomposition": f"""WITH s AS ({SERIES}), t AS ({TREND}), f AS (SELECT month, AVG(revenue / trend) AS factor FROM t WHERE trend IS NOT NULL GROUP BY month), n AS (SELECT month, factor / AVG(factor) OVER () AS seasonal FROM f)
SELECT t.month_start, t.revenue, ROUND(trend, 4) AS trend, ROUND(seasonal, 6) AS seasonal, ROUND(t.revenue / trend / seasonal, 6) AS residual FROM t JOIN n ON n.month = t.month""",
    "ts06_seasonal_index": f"""WITH s AS ({SERIES}), t AS ({TREND}), f AS (SELECT month, AVG(revenue / trend) AS factor FROM t WHERE trend IS NOT NULL GROUP BY month), x AS (SELECT month, factor / AVG(factor) OVER () AS seasonal, RANK() OVER (ORDER BY factor DESC) AS peak_rank FROM f),
r AS (SELECT LN(t.revenue / trend / seasonal) AS rest, LN(seasonal) AS season FROM t JOIN x ON x.month = t.month WHERE trend IS NOT NULL), v AS (SELECT VAR_POP(rest) AS rest, VAR_POP(season + rest) AS whole FROM r)
SELECT month, ROUND(seasonal, 6) AS seasonal_index, peak_rank, ROUND(GREATEST(0, 1 - rest / NULLIF(whole, 0)), 6) AS strength FROM x CROSS JOIN v""",
    "ts07_quarterly": f"WITH q AS (SELECT year_quarter, {S('revenue')} AS revenue, {S('profit')} AS profit, COUNT(*) AS transactions FROM {F_} GROUP BY 1) SELECT year_quarter, revenue, profit, transactions, {pct('profit', 'revenue')} AS margin_pct, ROUND(revenue / LAG(revenue) OVER w - 1, 6) AS qoq, ROUND(revenue / LAG(revenue, 4) OVER w - 1, 6) AS yoy, ROUND(profit / LAG(profit, 4) OVER w - 1, 6) AS profit_yoy FROM q WINDOW w AS (ORDER BY year_quarter)",
    "ts08_day_of_week": f"SELECT CAST(weekday AS BIGINT) AS weekday, CASE WHEN weekday >= 5 THEN 1 ELSE 0 END = 1 AS is_weekend, COUNT(*) AS transactions, {S('revenue')} AS revenue, ROUND({S('revenue')} / COUNT(*), 4) AS avg_value FROM {F_} GROUP BY weekday",
    "ts09_autocorrelation": f"WITH s AS ({SERIES}), m AS (SELECT AVG(revenue) AS mu FROM s), d AS (SELECT i, revenue - mu AS x FROM s CROSS JOIN m) SELECT CAST(b.i - a.i AS BIGINT) AS lag, ROUND(SUM(a.x * b.x) / MAX(v), 6) AS acf FROM d a JOIN d b ON b.i - a.i BETWEEN 0 AND 24 CROSS JOIN (SELECT SUM(x * x) AS v FROM d) t GROUP BY 1",
    "ts10_growth_decomposition": f"""WITH y AS (SELECT year, SUM({D2.format('revenue')}) AS revenue, SUM(transactions) AS transactions, MAX(active_customers) AS customers FROM v_monthly_revenue GROUP BY year), g AS (SELECT year, LN(CAST(revenue AS DOUBLE) / LAG(CAST(revenue AS DOUBLE)) OVER w) AS total, LN(customers * 1.0E0 / LAG(customers) OVER w) AS of_customers, LN((transactions * 1.0E0 / customers) / LAG(transactions * 1.0E0 / customers) OVER w) AS of_frequency FROM y WINDOW w AS (ORDER BY year))
SELECT year, ROUND(total, 6) AS log_growth, ROUND(of_customers, 6) AS of_customers, ROUND(of_frequency, 6) AS of_frequency, ROUND(total - of_customers - of_frequency, 6) AS of_value FROM g WHERE total IS NOT NULL""",
    "ts11_extreme_months": "WITH m AS (SELECT year_month, revenue, revenue / LAG(revenue) OVER (ORDER BY month_start) - 1 AS growth FROM v_monthly_revenue), r AS (SELECT m.*, ROW_NUMBER() OVER (ORDER BY growth, year_month) AS worst, ROW_NUMBER() OVER (ORDER BY growth DESC, year_month) AS best FROM m WHERE growth IS NOT NULL) SELECT year_month, revenue, ROUND(growth, 6) AS growth, worst, best FROM r WHERE worst <= 5 OR best <= 5",
    "ts12_calendar_gaps": "WITH n AS (SELECT year * 12 + month AS k FROM v_monthly_revenue) SELECT MAX(k) - MIN(k) + 1 AS months_spanned, COUNT(*) AS months_present, MAX(k) - MIN(k) + 1 - COUNT(*) AS months_missing FROM n",
}

# Long form: one row for each series and month. The ledger is summed once, by month, month and category, month and region.
_SUMS = ", ".join(f"SUM({x}) AS {x}" for x in ("gross_revenue", "discount_amount", "revenue", "cost", "profit"))
LONG = f"""SELECT CASE WHEN product_category IS NOT NULL THEN concat(metric, ': ', product_category) WHEN region IS NOT NULL THEN concat(metric, ': ', region) ELSE metric END AS series, month_start, value
 FROM (SELECT month_start, product_category, region, CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit, CAST(profit AS DOUBLE) * 100 / NULLIF(CAST(revenue AS DOUBLE), 0) AS margin, CAST(cost AS DOUBLE) * 100 / NULLIF(CAST(revenue AS DOUBLE), 0) AS cost_ratio,
   CAST(discount_amount AS DOUBLE) * 100 / NULLIF(CAST(gross_revenue AS DOUBLE), 0) AS discount, CAST(revenue AS DOUBLE) / n AS order_value, CAST(n AS DOUBLE) AS transactions
  FROM (SELECT month_start, product_category, region, {_SUMS}, COUNT(*) AS n FROM {F_} GROUP BY GROUPING SETS ((month_start), (month_start, product_category), (month_start, region))) g) w
 UNPIVOT (value FOR metric IN (revenue, profit, margin, cost_ratio, discount, order_value, transactions))
 WHERE (product_category IS NULL AND region IS NULL) OR (product_category IS NOT NULL AND metric IN ('margin', 'discount')) OR (region <> 'Unknown' AND metric IN ('revenue', 'discount'))
 UNION ALL SELECT concat('expense: ', expense_category), month, CAST(amount AS DOUBLE) FROM fact_operating_expenses
 UNION ALL SELECT 'marketing', month, CAST(SUM(spend) AS DOUBLE) FROM fact_marketing_spend GROUP BY month
 UNION ALL SELECT 'marketing_pct_of_revenue', month_start, spend * 100 / NULLIF(revenue, 0) FROM v_monthly_pnl JOIN (SELECT month, CAST(SUM(spend) AS DOUBLE) AS spend FROM fact_marketing_spend GROUP BY month) s ON month = month_start"""
GRADE = "CASE WHEN deviation_pct IS NOT NULL AND ABS(deviation_pct) < 5 THEN 'Low' WHEN ABS(score) >= 4.5 THEN 'Critical' WHEN ABS(score) >= 3.5 THEN 'High' ELSE 'Medium' END"
GLOBAL = f"""WITH l AS ({LONG}), m AS (SELECT series, AVG(value) AS mean, STDDEV_SAMP(value) AS sd, COUNT(value) AS n FROM l GROUP BY series),
z AS (SELECT l.series, month_start, value, ROUND((value - mean) / sd, 4) AS score, ROUND((value - mean) / NULLIF(ABS(mean), 0) * 100, 4) AS deviation_pct FROM l JOIN m ON m.series = l.series WHERE n >= 6 AND sd > 1e-9)"""
ROLLING = f"""WITH l AS ({LONG}), m AS (SELECT series, month_start, value, AVG(value) OVER w AS mean, STDDEV_SAMP(value) OVER w AS sd, COUNT(value) OVER w AS n, COUNT(value) OVER (PARTITION BY series) AS total FROM l WINDOW w AS (PARTITION BY series ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
z AS (SELECT series, month_start, value, ROUND((value - mean) / sd, 4) AS score, ROUND((value - mean) / NULLIF(ABS(mean), 0) * 100, 4) AS deviation_pct FROM m WHERE n = 6 AND total >= 8 AND sd > 1e-9)"""


CELL = "COALESCE(CAST(SIGN({0}) * FLOOR(64 * LOG2(1 + ABS({0}))) AS BIGINT), -1000000)"


def placed(rows: str, keys: str = "grp") -> str:
    """CTEs over `rows` (keys, x, n: how often x occurs in the group): `spot` (keys, x, n, upto: values up to x in the group, total), in two levels."""
    same = " AND ".join(f"go.{k.strip()} = vc.{k.strip()}" for k in keys.split(","))
    return f"""vc AS (SELECT {keys}, x, n, {CELL.format('x')} AS cell FROM {rows}), go AS (SELECT {keys}, cell, COALESCE(SUM(SUM(n)) OVER (PARTITION BY {keys} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(SUM(n)) OVER (PARTITION BY {keys}) AS total FROM vc GROUP BY {keys}, cell),
spot AS (SELECT vc.*, CAST(before + SUM(vc.n) OVER (PARTITION BY {', '.join('vc.' + k.strip() for k in keys.split(','))}, vc.cell ORDER BY vc.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto, CAST(total AS DOUBLE) AS total FROM vc JOIN go ON {same} AND go.cell = vc.cell)"""


def quantile(q: float) -> str:
    """A quantile by linear interpolation, as an aggregate over `spot`."""
    place = f"{q}E0 * (total - 1)"
    lo, hi = (f"MIN(CASE WHEN upto >= FLOOR({place}) + {k} THEN x END)" for k in (1, 2))
    return f"({lo} + (MAX({place}) - FLOOR(MAX({place}))) * (COALESCE({hi}, {lo}) - {lo}))"


def tukey(group: str, x: str, log: bool, condition: str = "1 = 1") -> str:
    """Fences of each group, how many rows are out, and the ten farthest above."""
    v = f"LN(CAST({x} AS DOUBLE))" if log else f"CAST({x} AS DOUBLE)"
    return f"""WITH v AS (SELECT {group} AS grp, {v} AS x, COUNT(*) AS n FROM {F_} WHERE {f'{x} > 0' if log else f'{x} IS NOT NULL'} AND {condition} GROUP BY 1, 2), {placed('v')},
q AS (SELECT grp, {quantile(0.25)} AS q1, {quantile(0.75)} AS q3, MAX(total) AS total FROM spot GROUP BY grp)
SELECT v.grp, ROUND(MAX(q1), 6) AS q1, ROUND(MAX(q3), 6) AS q3, CAST(SUM(v.n) AS BIGINT) AS rows_seen, {N('CASE WHEN x > q3 + 1.5E0 * (q3 - q1) THEN v.n ELSE 0 END')} AS above, {N('CASE WHEN x < q1 - 1.5E0 * (q3 - q1) THEN v.n ELSE 0 END')} AS below FROM v JOIN q ON q.grp = v.grp WHERE total >= 20 GROUP BY v.grp"""


def farthest(x: str, log: bool) -> str:
    """The ten rows farthest from the upper fence, of those out of the fences."""
    v = f"LN(CAST({x} AS DOUBLE))" if log else f"CAST({x} AS DOUBLE)"
    keep = f"{x} > 0" if log else f"{x} IS NOT NULL"
    return f"""WITH v AS (SELECT 'all' AS grp, {v} AS x, COUNT(*) AS n FROM {F_} WHERE {keep} GROUP BY 2), {placed('v')}, q AS (SELECT {quantile(0.25)} AS q1, {quantile(0.75)} AS q3 FROM spot GROUP BY grp),
f AS (SELECT order_id, line_number, product_id, CAST(gross_revenue AS DOUBLE) AS gross, {v} AS x, q3 + 1.5E0 * (q3 - q1) AS upper, q1 - 1.5E0 * (q3 - q1) AS lower FROM {F_} CROSS JOIN q WHERE {keep})
SELECT order_id, line_number, product_id, gross AS gross_revenue, ROUND(x, 6) AS value, ROUND(x - upper, 6) AS beyond_upper FROM f WHERE x > upper OR x < lower ORDER BY f.x - upper DESC, order_id, line_number, product_id, gross LIMIT 10"""


ANOMALY = {
    "d01_global_z": f"{GLOBAL} SELECT series, month_start, value, score, deviation_pct, {GRADE} AS severity FROM z WHERE ABS(score) >= 3",
    "d02_rolling_z": f"{ROLLING} SELECT series, month_start, value, score, deviation_pct, {GRADE} AS severity FROM z WHERE ABS(score) >= 3",
    "d04_tukey_revenue_log": tukey("'all'", "revenue", True),
    "d04_farthest_revenues": farthest("revenue", True),
    "d04_farthest_margins": farthest("profit_margin_pct", False),
    "d11_tukey_quantity_log": tukey("'all'", "quantity", True),
    "d11_tukey_margin": tukey("'all'", "profit_margin_pct", False),
    "d11_tukey_by_category": tukey("product_category", "revenue", True),
    "d13_summary": f"{ROLLING}, g AS (SELECT {GRADE} AS severity FROM z WHERE ABS(score) >= 3) SELECT severity, COUNT(*) AS flags FROM g GROUP BY 1",
}

#: Comparisons of two or more groups: name, group of a row (null: none), value. Analogues of the ledger's questions.
COMPARISONS = {
    "discount_vs_margin": ("CASE WHEN discount > 0.05 THEN 'a deep' ELSE 'b shallow' END", "profit_margin_pct", "1 = 1"),
    "region_order_value": ("CASE region WHEN 'ASIA' THEN 'a ASIA' WHEN 'EUROPE' THEN 'b EUROPE' END", "CAST(revenue AS DOUBLE)", "region IN ('ASIA', 'EUROPE')"),
    "regions_anova": ("region", "CAST(revenue AS DOUBLE)", "region <> 'Unknown'"),
    "margin_compression": ("CASE year WHEN 1996 THEN 'a 1996' WHEN 2000 THEN 'b 2000' END", "profit_margin_pct", "year IN (1996, 2000)"),
    "category_cost_shock": ("CASE year WHEN 2000 THEN 'a 2000' WHEN 1999 THEN 'b 1999' END", "profit_margin_pct", "product_category = (SELECT MIN(product_category) FROM dim_product) AND (transaction_date BETWEEN DATE '2000-08-01' AND DATE '2000-10-15' OR transaction_date BETWEEN DATE '1999-08-01' AND DATE '1999-10-15')"),
    "region_quantity": ("region", "CAST(quantity AS DOUBLE)", "1 = 1"),
    "weekend_effect": ("CASE WHEN is_weekend = 1 THEN 'a weekend' ELSE 'b weekday' END", "CAST(revenue AS DOUBLE)", "1 = 1"),
}


def groups(*names: str) -> str:
    """One row for each group of each comparison with all that the tests need: moments, median, deviations from it, rank sum, moments of logarithms.

    The ledger is read once, each row for every comparison; what follows runs over distinct values, placed in two
    levels, so no task sorts or ranks all of them.
    """
    names = names or tuple(COMPARISONS)
    choose = lambda of: "CASE test " + " ".join(f"WHEN '{k}' THEN {of(*COMPARISONS[k])}" for k in names) + " END"
    tests = ", ".join(f"('{k}')" for k in names)
    return f"""WITH l AS (SELECT test, {choose(lambda g, x, c: f"CASE WHEN {c} THEN {g} END")} AS grp, {choose(lambda g, x, c: x)} AS x FROM {F_} CROSS JOIN (VALUES {tests}) q(test)),
v AS (SELECT test, grp, x, COUNT(*) AS n FROM l WHERE grp IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2, 3), {placed('v', 'test, grp')},
o AS (SELECT test, cell, COALESCE(SUM(SUM(n)) OVER (PARTITION BY test ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vc GROUP BY test, cell), d AS (SELECT test, x, cell, SUM(n) AS n FROM vc GROUP BY test, x, cell),
r AS (SELECT d.test, d.x, d.n, before + SUM(d.n) OVER (PARTITION BY d.test, d.cell ORDER BY d.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (d.n - 1) / 2.0E0 AS mid FROM d JOIN o ON o.test = d.test AND o.cell = d.cell),
t AS (SELECT test, SUM(CAST(n AS DOUBLE) * n * n - n) AS ties FROM d GROUP BY test), s AS (SELECT spot.test, grp, SUM(CAST(spot.n AS DOUBLE) * mid) AS rank_sum FROM spot JOIN r ON r.test = spot.test AND r.x = spot.x GROUP BY spot.test, grp),
c AS (SELECT test, grp, CAST(SUM(n) AS BIGINT) AS n, SUM(n * x) / SUM(n) AS mean, {quantile(0.5)} AS median FROM spot GROUP BY test, grp),
m AS (SELECT v.test, v.grp, SUM(v.n * (x - mean) * (x - mean)) AS c2, SUM(v.n * (x - mean) * (x - mean) * (x - mean)) AS c3, SUM(v.n * ABS(x - median)) / SUM(v.n) AS z, SUM(v.n * (x - median) * (x - median)) AS z2, SUM(CASE WHEN x > 0 THEN v.n ELSE 0 END) AS log_n, SUM(CASE WHEN x > 0 THEN v.n * LN(x) END) AS log_sum, SUM(CASE WHEN x > 0 THEN v.n * LN(x) * LN(x) END) AS log_squares FROM v JOIN c ON c.test = v.test AND c.grp = v.grp GROUP BY v.test, v.grp)
SELECT c.test, c.grp, c.n, ROUND(mean, 6) AS mean, ROUND(SQRT(c2 / NULLIF(c.n - 1, 0)), 6) AS sd, ROUND(median, 6) AS median, ROUND(c3 / c.n / POWER(NULLIF(c2 / c.n, 0), 1.5E0), 6) AS skewness, ROUND(z, 6) AS mean_deviation, ROUND(SQRT(GREATEST(0, z2 - c.n * z * z) / NULLIF(c.n - 1, 0)), 6) AS sd_deviation,
 ROUND(rank_sum, 1) AS rank_sum, ROUND(ties, 0) AS ties, CAST(log_n AS BIGINT) AS log_n, ROUND(log_sum / NULLIF(log_n, 0), 6) AS log_mean, ROUND((log_squares - log_sum * log_sum / NULLIF(log_n, 0)) / NULLIF(log_n - 1, 0), 6) AS log_var
FROM c JOIN m ON m.test = c.test AND m.grp = c.grp JOIN s ON s.test = c.test AND s.grp = c.grp JOIN t ON t.test = c.test"""


CONTINGENCY = f"""WITH o AS (SELECT payment_type, customer_segment, COUNT(*) AS n FROM {F_} WHERE payment_type <> 'Unknown' AND customer_segment <> 'Unknown' GROUP BY 1, 2), e AS (SELECT n, SUM(n) OVER (PARTITION BY payment_type) * 1.0E0 * SUM(n) OVER (PARTITION BY customer_segment) / SUM(n) OVER () AS e, payment_type, customer_segment FROM o),
k AS (SELECT SUM((n - e) * (n - e) / e) AS chi, COUNT(DISTINCT payment_type) - 1 AS r, COUNT(DISTINCT customer_segment) - 1 AS c, SUM(n) AS n, MIN(e) AS least FROM e)
SELECT ROUND(chi, 6) AS chi_square, CAST(r * c AS BIGINT) AS df, CAST(n AS BIGINT) AS n, ROUND(least, 4) AS least_expected, ROUND(SQRT(chi / n / GREATEST(LEAST(r, c), 1)), 6) AS cramers_v FROM k"""

#: Pairs of columns whose correlation is asked for: of transactions, and of months.
PAIRS = (("discount", "profit_margin_pct"), ("quantity", "revenue"), ("cost", "profit"), ("unit_price", "profit_margin_pct"), ("discount", "quantity"), ("gross_revenue", "discount_amount"))
MONTHLY_PAIRS = (("marketing_spend", "revenue"), ("marketing_spend", "revenue_next_month"), ("avg_discount", "margin_pct"), ("cost", "revenue"), ("transactions", "revenue"))
MONTHS = f"""(SELECT month_start, v.revenue, LEAD(v.revenue) OVER (ORDER BY month_start) AS revenue_next_month, v.cost, v.transactions, profit_margin_pct AS margin_pct, spend AS marketing_spend, avg_discount FROM v_monthly_revenue v
 LEFT JOIN (SELECT month, {S('spend')} AS spend FROM fact_marketing_spend GROUP BY 1) s ON s.month = month_start JOIN (SELECT month_start AS m, CAST(SUM(discount) AS DOUBLE) / COUNT(*) AS avg_discount FROM {F_} GROUP BY 1) d ON d.m = month_start)"""


def correlations(pairs: tuple[tuple[str, str], ...], source: str = F_) -> str:
    """Pearson's and Spearman's coefficients of pairs of columns: one pass over the source, then distinct pairs of values, whose ranks are placed in two levels."""
    choose = lambda k: "CASE pair " + " ".join(f"WHEN '{p[0]} vs {p[1]}' THEN CAST({p[k]} AS DOUBLE)" for p in pairs) + " END"

    def mid(name: str) -> str:
        return f"""{name}1 AS (SELECT pair, {name} AS x, SUM(n) AS n, {CELL.format(name)} AS cell FROM v GROUP BY pair, {name}), {name}2 AS (SELECT pair, cell, COALESCE(SUM(SUM(n)) OVER (PARTITION BY pair ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}1 GROUP BY pair, cell),
{name}3 AS (SELECT p.pair, p.x, before + SUM(n) OVER (PARTITION BY p.pair, p.cell ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (n - 1) / 2.0E0 AS mid FROM {name}1 p JOIN {name}2 o ON p.pair = o.pair AND p.cell = o.cell)"""

    def coefficient(x: str, y: str) -> str:
        c = lambda p, q: f"(SUM(n * (w.{p} - m.{p}0) * (w.{q} - m.{q}0)))"
        return f"{c(x, y)} / NULLIF(SQRT({c(x, x)} * {c(y, y)}), 0)"

    return f"""WITH l AS (SELECT pair, {choose(0)} AS a, {choose(1)} AS b FROM {source} src CROSS JOIN (VALUES {', '.join(f"('{a} vs {b}')" for a, b in pairs)}) q(pair)),
v AS (SELECT pair, a, b, COUNT(*) AS n FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3), {mid('a')}, {mid('b')},
w AS (SELECT v.pair, v.a, v.b, CAST(v.n AS DOUBLE) AS n, a3.mid AS ra, b3.mid AS rb FROM v JOIN a3 ON a3.pair = v.pair AND a3.x = v.a JOIN b3 ON b3.pair = v.pair AND b3.x = v.b), m AS (SELECT pair, SUM(n * a) / SUM(n) AS a0, SUM(n * b) / SUM(n) AS b0, SUM(n * ra) / SUM(n) AS ra0, SUM(n * rb) / SUM(n) AS rb0 FROM w GROUP BY pair)
SELECT w.pair, CAST(SUM(n) AS BIGINT) AS n, ROUND({coefficient('a', 'b')}, 6) AS pearson_r, ROUND({coefficient('ra', 'rb')}, 6) AS spearman_rho FROM w JOIN m ON m.pair = w.pair GROUP BY w.pair"""


def moments(group: str, x: str, condition: str = "1 = 1") -> str:
    """Size, mean, variance of x by group, and the ANOVA sums of all groups."""
    return f"""WITH v AS (SELECT {group} AS grp, {x} AS x FROM {F_} WHERE {condition}), g AS (SELECT grp, COUNT(*) AS n, AVG(x) AS mean, VAR_SAMP(x) AS var FROM v GROUP BY grp), t AS (SELECT SUM(n * mean) / SUM(n) AS grand FROM g)
SELECT grp, n, ROUND(mean, 6) AS mean, ROUND(var, 4) AS var, ROUND(n * (mean - grand) * (mean - grand), 3) AS between_part, ROUND((n - 1) * var / 1000, 2) AS within_part FROM g CROSS JOIN t"""


MEANS = f"""SELECT 'Average transaction value' AS name, COUNT(*) AS n, AVG(CAST(revenue AS DOUBLE)) AS mean, VAR_SAMP(CAST(revenue AS DOUBLE)) AS var FROM {F_}
UNION ALL SELECT 'Average profit per transaction', COUNT(*), AVG(CAST(profit AS DOUBLE)), VAR_SAMP(CAST(profit AS DOUBLE)) FROM {F_}
UNION ALL SELECT 'Revenue per customer (lifetime)', COUNT(*), AVG(r), VAR_SAMP(r) FROM (SELECT customer_id, {S('revenue')} AS r FROM {F_} WHERE is_customer_attributed = 1 GROUP BY 1) c
UNION ALL SELECT 'Average transaction profit margin (%)', COUNT(profit_margin_pct), AVG(profit_margin_pct), VAR_SAMP(profit_margin_pct) FROM {F_}
UNION ALL SELECT 'Proportion of loss-making transactions', COUNT(*), AVG(CAST(is_loss_making AS DOUBLE)), NULL FROM {F_}
UNION ALL SELECT 'Average discount rate', COUNT(*), AVG(CAST(discount AS DOUBLE)), VAR_SAMP(CAST(discount AS DOUBLE)) FROM {F_}"""
STATS = {"t11_groups": groups(), "t09_correlations": correlations(PAIRS), "t10_monthly_correlations": correlations(MONTHLY_PAIRS, MONTHS)}
STATS |= {
    "t08_loss_share": f"""WITH g AS (SELECT payment_type, COUNT(*) AS n, {N('is_loss_making')} AS k FROM {F_} GROUP BY 1), w AS (SELECT g.*, k / CAST(n AS DOUBLE) AS p, 3.8414588206941254E0 / n AS z2 FROM g)
SELECT payment_type, n, k, {R('p', 6)} AS share, ROUND((p + z2 / 2) / (1 + z2) - SQRT(z2 * p * (1 - p) + z2 * z2 / 4) / (1 + z2), 6) AS low, ROUND((p + z2 / 2) / (1 + z2) + SQRT(z2 * p * (1 - p) + z2 * z2 / 4) / (1 + z2), 6) AS high FROM w""",
    "t01_moments_discount_depth": moments("CASE WHEN discount > 0.05 THEN 'deep' ELSE 'shallow' END", "profit_margin_pct", "revenue > 0"),
    "t04_moments_region": moments("region", "CAST(revenue AS DOUBLE)"),
    "t09_corr_customers_revenue": f"SELECT pearson_r AS pearson, spearman_rho AS spearman, n FROM ({correlations((('active_customers', 'revenue'),), 'v_monthly_revenue')}) c",
    "t10_corr_revenue_margin": f"SELECT pearson_r AS pearson, spearman_rho AS spearman, n FROM ({correlations((('revenue', 'profit_margin_pct'),), 'v_monthly_revenue')}) c",
    "t12_ranks_weekend": f"SELECT SUBSTR(grp, 3) AS grp, n, rank_sum, ties FROM ({groups('weekend_effect')}) g",
    "t13_levene_region": f"SELECT grp AS region, n, ROUND(mean_deviation, 4) AS mean_deviation FROM ({groups('regions_anova')}) g",
    "t15_ranks_region": f"SELECT grp, n, rank_sum, ties FROM ({groups('region_quantity')}) g",
    "t17_chi_square_payment_segment": CONTINGENCY,
    "t06_means": f"SELECT name, n, ROUND(mean, 7) AS mean, ROUND(SQRT(var), 5) AS sd FROM ({MEANS}) m",
}

SQL = {**KPI, **TIME, **ANOMALY, **STATS}
