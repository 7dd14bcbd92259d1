"""Cleaning of untidy transaction extracts: standardise, parse, deduplicate, validate, repair, reconcile.

A raw extract is all text. Every step is a projection, an aggregate with a join, or a window over a business key; the
order of rows is an explicit column (seq), so "keep the first" does not depend on the layout of files. `dirty` makes
such an extract from the order tables by rule, so that another engine can make the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, kept, shared_dir
from .order import FEW

#: Date formats in the order in which they are tried, spellings, bounds.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "yyyy.M.d", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d")
REGION_ALIASES = {"asia": "ASIA", "asi": "ASIA", "europe": "EUROPE", "eur": "EUROPE", "america": "AMERICA", "amer": "AMERICA", "africa": "AFRICA", "afr": "AFRICA", "middleeast": "MIDDLE EAST", "mideast": "MIDDLE EAST"}
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN = r"^[0-9]+([.][0-9]+)?\z"
MAX_QUANTITY, MAX_PRICE, TOLERANCE = 5000, 100000, 0.01
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"
NULLS = ("", "nan", "NaN", "None", "NULL")
LABELS = ("product_category", "customer_segment", "payment_type")
NUMBERS = ("quantity", "unit_price", "unit_cost", "discount", "revenue", "cost", "profit")
BUSINESS_KEY = ("transaction_date", "customer_id", "product_id", "quantity", "unit_price", "discount")


def text(c: Column) -> Column:
    """Trimmed text; the spellings of nothing are null."""
    t = F.trim(c)
    return F.when(~t.isin(*NULLS), t)


def key(c: Column) -> Column:
    """Lower-case letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """The canonical value of a spelling; null for spellings unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), key(c))


def customer_id(c: Column) -> Column:
    """CUST- and the first run of digits, padded to five; null without digits."""
    padded = F.concat(F.lit("0000"), F.regexp_extract(c, "([0-9]+)", 1))
    return F.nullif(F.concat(F.lit("CUST-"), F.regexp_extract(padded, "^0*([0-9]{5,})$", 1)), F.lit("CUST-"))  # longer ones stay whole


def number(c: Column) -> Column:
    """Numbers with currency signs, thousands separators and percent signs; null for anything else."""
    bare = F.regexp_replace(c, r"[$,\s]", "")
    percent = bare.endswith("%")
    bare = F.regexp_replace(bare, "%$", "")
    value = F.when(bare.rlike(NUMBER), bare).try_cast("double")
    return F.when(c.rlike(PLAIN), c.try_cast("double")).otherwise(F.when(percent, value / 100).otherwise(value))  # most are plain, and need no replacing


def date(c: Column) -> Column:
    """The first format that fits; day before month."""
    return F.coalesce(*[F.try_to_date(c, f) for f in DATE_FORMATS])


def parse(raw: DataFrame) -> DataFrame:
    """Typed columns. Texts are trimmed and numbers parsed as one array each: one expression for all of them keeps a row's compiled method below 8,000 bytes, beyond which the JVM only interprets it."""
    columns = [c for c in raw.columns if c != "seq"]
    texts = raw.select("seq", F.transform(F.array(*columns), text).alias("texts")).select("seq", *[F.col("texts")[k].alias(c) for k, c in enumerate(columns)])
    out = texts.select(
        "seq", F.upper("transaction_id").alias("transaction_id"), date(F.col("transaction_date")).alias("transaction_date"), customer_id(F.col("customer_id")).alias("customer_id"),
        F.upper("product_id").alias("product_id"), canonical(F.col("region"), REGION_ALIASES).alias("region"),
        *[F.upper(c).alias(c) for c in LABELS], F.transform(F.array(*NUMBERS), number).alias("numbers"),
    )
    return out.select(*[c for c in out.columns if c != "numbers"], *[F.col("numbers")[k].alias(c) for k, c in enumerate(NUMBERS)])


def passes(df: DataFrame) -> list[tuple[str, DataFrame]]:
    """Three passes, each over the one before: identical rows, transaction ids, business keys; the first by seq stays. Nulls are equal.

    Each pass is an aggregate whose partial results meet, so rows that share a key (all those without one, say) do not
    gather in one task as they would under a window.
    """
    return _passes(df, lambda _, out: out)


#: The passes, and the columns by which rows are the same (none: all but seq).
PASSES = (("identical rows", None), ("same transaction id", ("transaction_id",)), ("same business key", BUSINESS_KEY))


def _passes(df: DataFrame, seen: Callable[[str, DataFrame], DataFrame], which: tuple = PASSES) -> list[tuple[str, DataFrame]]:
    columns, out = df.columns, []
    for name, keys in which:
        if keys:
            df = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), "seq").alias("row")).select("row.*").select(*columns)
        else:
            df = df.groupBy(*[c for c in columns if c != "seq"]).agg(F.min("seq").alias("seq")).select(*columns)
        df = seen(name, df)
        out.append((name, df))
    return out


#: Hashes that may be broadcast, of eight bytes each.
MARKS = 1_000_000


def deduplicate(df: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda out: out) -> DataFrame:
    """What the last of the passes leaves; hold may write what they leave of the rows that share a key.

    Identical rows have one transaction id, so the first row of an id is also the first of those identical to it: the pass
    over identical rows changes nothing of what is left, and is run only where its count is asked for.
    """
    alone, shared = parted(df)
    once = [] if shared is None else [hold(_passes(shared, lambda _, out: out, PASSES[1:])[-1][1])]
    return reduce(DataFrame.unionByName, [alone, *once])


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """df in two: the rows that share neither transaction id nor business key with another row, and the others, if there are any.

    No pass can drop one of the first, so only the others go through the passes. What travels for that is a hash of each key;
    rows of different keys whose hashes meet are among the others, and the passes keep them. df is read three times, so it
    should be held. Where more than MARKS hashes repeat, all rows are among the others.
    """
    marks = [F.xxhash64(F.lit(k), *keys) for k, (_, keys) in enumerate(PASSES) if keys]
    repeated = kept(df.select(F.explode(F.array(*marks)).alias("mark")).groupBy("mark").count().filter("count > 1").select("mark"))
    n = repeated.count()
    if n == 0:
        return df, None
    if n > MARKS:
        return df.filter(F.lit(False)), df
    met = df
    for k, mark in enumerate(marks):
        met = met.withColumn(f"mark_{k}", mark).join(F.broadcast(repeated.withColumnRenamed("mark", f"again_{k}")), F.col(f"mark_{k}") == F.col(f"again_{k}"), "left")
    again = reduce(Column.__or__, [F.col(f"again_{k}").isNotNull() for k in range(len(marks))])
    return met.filter(~again).select(*df.columns), met.filter(again).select(*df.columns)


#: The reasons for which a row is rejected, in the order in which they are tried.
REASONS = (
    "unparseable_transaction_date", "date_before_business_start", "date_in_the_future", "non_positive_quantity", "implausible_quantity",
    "non_positive_unit_price", "implausible_unit_price", "discount_outside_0_1", "missing_product_id",
)


def broken() -> dict[str, Column]:
    """Whether a row breaks each rule."""
    d, q, p = F.col("transaction_date"), F.col("quantity"), F.col("unit_price")
    tests = (d.isNull(), d < F.lit(FIRST_DAY).cast("date"), d > F.lit(LAST_DAY).cast("date"), q <= 0, q > MAX_QUANTITY, p <= 0, p > MAX_PRICE, (F.col("discount") < 0) | (F.col("discount") > 1), F.col("product_id").isNull())
    return dict(zip(REASONS, tests, strict=True))


def rejection() -> Column:
    """The first rule that a row breaks, or null."""
    out = F.lit(None).cast("string")
    for reason, test in reversed(broken().items()):
        out = F.when(test, reason).otherwise(out)
    return out


def rounded(e: Column, n: int = 2) -> Column:
    """Half up, by way of a decimal, so that engines agree."""
    return F.round(e.cast("decimal(24,6)"), n).cast("double")


#: What `repair` mends, in order; each is a column of flags in its result.
REPAIRS = ("category", "region", "segment", "price_solved", "cost_solved", "price_median", "cost_median", "discount", "payment", "customer", "region_unknown", "segment_unknown")


def _repeats(master: DataFrame, key: str) -> bool:
    """Whether a key is there more than once."""
    return not master.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty()


def repair(df: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Fill what is missing, best source first, with one flag (fixed_*) for each of REPAIRS.

    Masters: products (product_id, m_category, m_price, m_cost), customers (customer_id, m_region, m_segment). Then sums:
    price from revenue, cost from its unit or the other way round. Then medians of the product (taken after the sums), its
    list price; discounts by the segment's median, then the median of all. What is left is labelled as unknown.

    Only rows that lack something travel to the masters and the medians, and only products that lack a price or a cost have
    their medians taken. df is read several times, so it should be held. Where a master has a key twice, the joins give its
    rows twice, so there all rows travel.
    """
    fill = lambda flag, c, *by: {f"fixed_{flag}": F.col(c).isNull() & F.coalesce(*by).isNotNull(), c: F.coalesce(c, *by)}
    q, net = F.col("quantity"), F.col("quantity") * (1 - F.coalesce("discount", F.lit(0.0)))
    df = df.withColumns(fill("price_solved", "unit_price", F.when((q > 0) & (net > 0), F.col("revenue") / net)) | fill("cost_solved", "unit_cost", F.when(q > 0, F.col("cost") / q)))
    lacks = reduce(Column.__or__, [F.col(c).isNull() for c in ("product_category", "region", "customer_segment", "unit_price", "unit_cost")])
    lacks = F.lit(True) if _repeats(products, "product_id") or _repeats(customers, "customer_id") else lacks
    lacking = kept(df.filter(lacks).join(products, "product_id", "left").join(customers, "customer_id", "left"), compression="zstd")
    nothing = {c: F.lit(None).cast(t) for c, t in lacking.dtypes if c not in df.columns}
    whole = df.filter(~lacks).withColumns(nothing)
    priced = whole.unionByName(lacking).select("product_id", "unit_price", "unit_cost")
    unpriced = kept(lacking.filter("unit_price IS NULL OR unit_cost IS NULL").select("product_id").distinct())
    medians = priced.join(unpriced, "product_id", "left_semi").groupBy("product_id").agg(F.median("unit_price").alias("p_price"), F.median("unit_cost").alias("p_cost"))
    own = {c: F.lit(None).cast("double") for c in ("p_price", "p_cost")}
    df = whole.withColumns(own).unionByName(lacking.join(kept(medians), "product_id", "left"))
    df = df.withColumns(fill("category", "product_category", "m_category") | fill("region", "region", "m_region") | fill("segment", "customer_segment", "m_segment"))
    # Segments are few, so the rows do not gather by segment: discounts are counted first, and what they give is broadcast.
    counts = cut(df.groupBy(F.col("customer_segment").alias("s_segment"), "discount").agg(F.count("*").alias("n")))
    by_segment = cut(counts.groupBy("s_segment").agg(F.expr("percentile(discount, 0.5D, n)").alias("s_discount")))
    dealt = counts.join(by_segment.withColumnRenamed("s_segment", "b_segment"), F.col("s_segment") == F.col("b_segment"), "left")
    overall = cut(dealt.agg(F.expr("percentile(COALESCE(discount, s_discount), 0.5D, n)").alias("a_discount")))
    df = df.withColumns(fill("price_median", "unit_price", "p_price", "m_price") | fill("cost_median", "unit_cost", "p_cost", "m_cost"))
    df = df.withColumn("cost", F.coalesce("cost", F.col("unit_cost") * q))
    df = df.join(F.broadcast(by_segment) if by_segment.count() <= FEW else by_segment, df.customer_segment == by_segment.s_segment, "left")
    df = df.crossJoin(F.broadcast(overall))  # overall is one row
    df = df.withColumns(fill("discount", "discount", "s_discount", "a_discount") | {"is_customer_attributed": F.col("customer_id").isNotNull().cast("long")})
    unknown = lambda flag, c, label: fill(flag, c, F.lit(label))
    df = df.withColumns(unknown("payment", "payment_type", "Unknown") | unknown("customer", "customer_id", "UNATTRIBUTED") | unknown("region_unknown", "region", "Unknown") | unknown("segment_unknown", "customer_segment", "Unknown"))
    return df.select("seq", "transaction_id", "transaction_date", "customer_id", "is_customer_attributed", "product_id", "region", *LABELS, *NUMBERS, *[f"fixed_{r}" for r in REPAIRS])


def reconcile(df: DataFrame) -> DataFrame:
    """Money recomputed from its parts; reported figures that differ by more than the tolerance are flagged. Parts win."""
    off = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"new_{c}")) > TOLERANCE, F.lit(False))
    df = df.withColumn("gross_revenue", rounded(F.col("quantity") * F.col("unit_price")))
    df = df.withColumn("discount_amount", rounded(F.col("gross_revenue") * F.col("discount")))
    df = df.withColumns({"new_revenue": rounded(F.col("gross_revenue") - F.col("discount_amount")), "new_cost": rounded(F.col("quantity") * F.col("unit_cost"))})
    df = df.withColumn("new_profit", rounded(F.col("new_revenue") - F.col("new_cost")))
    df = df.withColumns({"revenue_off": off("revenue"), "cost_off": off("cost"), "profit_off": off("profit"), "reported_revenue": F.col("revenue"), "revenue_variance": rounded(F.col("revenue") - F.col("new_revenue"))})
    df = df.withColumns({c: F.col(f"new_{c}") for c in ("revenue", "cost", "profit")})
    earns = F.col("revenue") > 0
    return df.withColumns({
        "profit_margin_pct": F.when(earns, rounded(F.col("profit") / F.col("revenue") * 100, 4)),
        "unit_margin": rounded(F.col("unit_price") * (1 - F.col("discount")) - F.col("unit_cost"), 4),
        "cost_to_revenue_ratio": F.when(earns, rounded(F.col("cost") / F.col("revenue"), 4)),
        "is_loss_making": (F.col("profit") < 0).cast("long"),
        "had_reconciliation_error": F.col("revenue_off") | F.col("cost_off") | F.col("profit_off"),
    }).drop("new_revenue", "new_cost", "new_profit")


def masters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The product and customer masters that repairs look things up in."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    price = F.col("p_retailprice")
    products = read("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"), F.upper("p_type").alias("m_category"), price.alias("m_price"), rounded(price * 0.9, 4).alias("m_cost"))
    where = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(F.format_string("CUST-%05d", "c_custkey").alias("customer_id"), F.col("r_name").alias("m_region"), F.upper("c_mktsegment").alias("m_segment"))
    return products, customers


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An untidy extract made from the order lines by rule."""
    for t in ("orders", "lineitem", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(_RULE.format(iso="date_format(d, 'yyyy-MM-dd')", dmy="date_format(d, 'dd/MM/yyyy')", dots="date_format(d, 'yyyy.MM.dd')") + _SPARK_LINES)


#: The rule, for both engines but for how dates are written.
_RULE = """SELECT seq, concat('T', CAST(o AS STRING), '-', CAST(n AS STRING)) AS transaction_id,
 CASE WHEN seq % 17 = 0 THEN {dmy} WHEN seq % 19 = 0 THEN {dots} WHEN seq % 97 = 0 THEN '2024-13-45' WHEN seq % 89 = 0 THEN concat(' ', {iso}, ' ') ELSE {iso} END AS transaction_date,
 CASE WHEN seq % 53 = 0 THEN '' WHEN seq % 7 = 0 THEN concat(' cust_', CAST(c AS STRING)) ELSE concat('CUST-', CAST(c AS STRING)) END AS customer_id,
 CASE WHEN seq % 113 = 0 THEN 'NULL' ELSE concat('p', CAST(p AS STRING)) END AS product_id,
 CASE WHEN seq % 23 = 0 THEN LOWER(r) WHEN seq % 29 = 0 THEN concat(SUBSTR(r, 1, 3), '.') WHEN seq % 31 = 0 THEN 'N/A' ELSE r END AS region,
 CASE WHEN seq % 101 = 0 THEN '-2' ELSE CAST(q AS STRING) END AS quantity,
 CASE WHEN seq % 37 = 0 THEN concat('$', CAST(price AS STRING)) WHEN seq % 43 = 0 THEN 'n/a' ELSE CAST(price AS STRING) END AS unit_price,
 CASE WHEN seq % 47 = 0 THEN '' ELSE CAST(CAST(FLOOR(price) AS DECIMAL(12,2)) AS STRING) END AS unit_cost,
 CASE WHEN seq % 41 = 0 THEN concat(CAST(CAST(disc * 100 AS DECIMAL(6,2)) AS STRING), '%') WHEN seq % 59 = 0 THEN '1.5' ELSE CAST(disc AS STRING) END AS discount,
 CASE WHEN seq % 61 = 0 THEN '9,999.99' ELSE CAST(CAST(q * price AS DECIMAL(14,2)) AS STRING) END AS revenue,
 CASE WHEN seq % 67 = 0 THEN ' ' WHEN seq % 71 = 0 THEN LOWER(cat) ELSE cat END AS product_category, CASE WHEN seq % 73 = 0 THEN 'None' WHEN seq % 11 = 0 THEN concat(seg, ' ') ELSE seg END AS customer_segment, CASE WHEN seq % 79 = 0 THEN 'NaN' ELSE pay END AS payment_type,
 CASE WHEN seq % 83 = 0 THEN '' ELSE CAST(CAST(q * FLOOR(price) AS DECIMAL(14,2)) AS STRING) END AS cost, CASE WHEN seq % 61 = 0 THEN '-' ELSE CAST(CAST(q * (price - FLOOR(price)) AS DECIMAL(14,2)) AS STRING) END AS profit
"""
_DUCK_LINES = """FROM (SELECT l_orderkey * 8 + l_linenumber AS seq, l_orderkey AS o, l_linenumber AS n, o_custkey AS c, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, CAST(FLOOR(l_extendedprice * 100 / l_quantity) AS DECIMAL(10,0)) * CAST(0.01 AS DECIMAL(3,2)) AS price, CAST(l_discount AS DECIMAL(6,2)) AS disc, CAST(o_orderdate AS DATE) AS d, r_name AS r, p_type AS cat, c_mktsegment AS seg, o_orderpriority AS pay
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS once FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE once = 1) x"""
#: The same lines for Spark: they travel by order once, for their numbers and their order, then by part, both times with few columns; orders meet their customers before.
_SPARK_LINES = """FROM (SELECT /*+ MERGE(part) */ o * 8 + n AS seq, o, n, c, p, CAST(quantity AS BIGINT) AS q, price, disc, d, r, p_type AS cat, seg, pay
  FROM (SELECT /*+ MERGE(b) */ o, n, p, quantity, CAST(FLOOR(l_extendedprice * 100 / quantity) AS DECIMAL(10,0)) * CAST(0.01 AS DECIMAL(3,2)) AS price, disc, c, d, r, seg, pay
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o, n ORDER BY p, l_suppkey, l_extendedprice, l_shipdate) AS once
      FROM (SELECT /*+ REPARTITION(o) */ * FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey, l_extendedprice, l_shipdate, l_quantity AS quantity, CAST(l_discount AS DECIMAL(6,2)) AS disc FROM lineitem) s) t) l
    JOIN (SELECT /*+ MERGE(customer) */ o_orderkey, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS pay, c_mktsegment AS seg, r_name AS r
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) b ON o = o_orderkey WHERE once = 1) m
  JOIN part ON p = p_partkey) x"""


def _number_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({c}), '[$,\\s]', '', 'g'), '%$', '')"
    value = f"CASE WHEN regexp_matches({bare}, '{NUMBER}') THEN TRY_CAST({bare} AS DOUBLE) END"
    return f"CASE WHEN trim({c}) LIKE '%\\%' ESCAPE '\\' THEN ({value}) / 100 ELSE {value} END AS {c}"


_DIRT_DUCK = (_RULE + _DUCK_LINES).format(iso="strftime(d, '%Y-%m-%d')", dmy="strftime(d, '%d/%m/%Y')", dots="strftime(d, '%Y.%m.%d')")
_REGIONS = "CASE regexp_replace(lower(trim(region)), '[^a-z0-9]', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_ALIASES.items()) + " END"
PARSED_SQL = f"""SELECT seq, upper(trim(transaction_id)) AS transaction_id,
 CAST(coalesce(try_strptime(trim(transaction_date), '%Y-%m-%d'), try_strptime(trim(transaction_date), '%d/%m/%Y'), try_strptime(trim(transaction_date), '%Y.%m.%d')) AS DATE) AS transaction_date,
 CASE WHEN regexp_extract(customer_id, '([0-9]+)', 1) <> '' THEN concat('CUST-', lpad(regexp_extract(customer_id, '([0-9]+)', 1), 5, '0')) END AS customer_id,
 CASE WHEN trim(product_id) NOT IN ('', 'NULL') THEN upper(trim(product_id)) END AS product_id, {_REGIONS} AS region, {', '.join(f"CASE WHEN trim({c}) NOT IN ('', 'nan', 'NaN', 'None', 'NULL') THEN upper(trim({c})) END AS {c}" for c in LABELS)}, {', '.join(_number_sql(c) for c in NUMBERS)}
FROM ({_DIRT_DUCK}) raw"""
REASON_SQL = f"""CASE WHEN transaction_date IS NULL THEN 'unparseable_transaction_date' WHEN transaction_date < DATE '{FIRST_DAY}' THEN 'date_before_business_start' WHEN transaction_date > DATE '{LAST_DAY}' THEN 'date_in_the_future' WHEN quantity <= 0 THEN 'non_positive_quantity'
 WHEN quantity > {MAX_QUANTITY} THEN 'implausible_quantity' WHEN unit_price <= 0 THEN 'non_positive_unit_price' WHEN unit_price > {MAX_PRICE} THEN 'implausible_unit_price' WHEN discount < 0 OR discount > 1 THEN 'discount_outside_0_1' WHEN product_id IS NULL THEN 'missing_product_id' END"""


def c01_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(dirty(spark, sf_dir))


def c01_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each text column trimming changes."""
    raw = dirty(spark, sf_dir)
    columns = [c for c in raw.columns if c != "seq"]
    counts = raw.agg(*[F.sum((F.col(c) != F.trim(c)).cast("long")).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "cells")


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Held, as the rows are read for their keys and then for themselves.
    return deduplicate(kept(c01_parsed(spark, sf_dir), compression="zstd"), kept).withColumn("reason", rejection())


def c11_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c01_parsed(spark, sf_dir).withColumn("reason", rejection()).groupBy("reason").agg(F.count("*").alias("rows"))


def c11_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule, whether or not another rule rejects them first."""
    counts = _unique(spark, sf_dir).agg(*[F.sum(F.coalesce(test, F.lit(False)).cast("long")).alias(r) for r, test in broken().items()])
    return counts.unpivot([], list(REASONS), "reason", "rows")


def c12_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected rows, with the first reason of each."""
    return _unique(spark, sf_dir).filter(F.col("reason").isNotNull())


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_unique(spark, sf_dir).filter(F.col("reason").isNull()).drop("reason"), *masters(spark, sf_dir))


def c13_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each repair touches."""
    counts = _repaired(spark, sf_dir).agg(*[F.sum(F.col(f"fixed_{r}").cast("long")).alias(r) for r in REPAIRS])
    return counts.unpivot([], list(REPAIRS), "repair", "rows")


def c18_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(_repaired(spark, sf_dir)).drop(*[f"fixed_{r}" for r in REPAIRS])


AUDIT = "place long, step string, detail string, rows_affected long"


def audited(raw: DataFrame, products: DataFrame, customers: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Clean an extract into path/parsed, path/unique (rows that are there once, with the reason to reject them), path/clean and path/rejected.

    Returns one row for each step (AUDIT) and the totals. All counts are observed in the jobs that write the rows, so
    nothing is read again for them; the passes count the rows that share a key, what shares none is left by all of them.
    Counts come from accumulators, so where a lost executor's task is run again they may be too high. The last step counts the files' rows from their footers, and stops with an error if these differ.
    An empty extract gives an audit of zeros.
    """
    spark, n = raw.sparkSession, F.count(F.lit(1)).alias("rows")
    held: dict[str, Observation] = {}
    nothing = dict.fromkeys((*REPAIRS, "revenue_off", "cost_off", "profit_off", "had_reconciliation_error", "rows"), 0) | dict.fromkeys(("revenue", "cost", "profit", "first", "last"))

    def seen(name: str, df: DataFrame, *what: Column) -> DataFrame:
        held[name] = Observation()
        return df.observe(held[name], *(what or (n,)))

    ones = lambda test, name: F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("long")), F.lit(0)).alias(name)
    texts = [c for c in raw.columns if c != "seq"]
    trimmed = sum(((F.coalesce(F.col(c) != F.trim(c), F.lit(False))).cast("long") for c in texts), F.lit(0))
    read = seen("read", raw, n, F.coalesce(F.sum(trimmed), F.lit(0)).alias("cells"))
    own = seen("parse", parse(read), ones(F.col("transaction_date").isNull(), "undated"))
    put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    put(own, "parsed")
    unique, shared = parted(spark.read.parquet(f"{path}/parsed"))
    if shared is not None:  # rows that are identical share a transaction id as well
        unique = unique.unionByName(_passes(seen("shared", shared), seen)[-1][1])
    unique = unique.withColumn("reason", rejection())
    put(seen("reject", unique, n, *(ones(F.col("reason") == r, r) for r in REASONS)), "unique")
    unique = spark.read.parquet(f"{path}/unique")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).alias(c)
    off = ("revenue_off", "cost_off", "profit_off", "had_reconciliation_error")
    clean = reconcile(repair(unique.filter("reason IS NULL").drop("reason"), products, customers))
    what = [n, *(ones(F.col(f"fixed_{r}"), r) for r in REPAIRS), *(ones(F.col(c), c) for c in off), *map(money, ("revenue", "cost", "profit")), F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last")]
    put(seen("clean", clean, *what).drop(*[f"fixed_{r}" for r in REPAIRS]), "clean")
    put(unique.filter("reason IS NOT NULL"), "rejected")
    # Where no row meets an observation, no task tells of one.
    zeros = {"read": {"rows": 0, "cells": 0}, "parse": {"undated": 0}, "reject": dict.fromkeys(REASONS, 0) | {"rows": 0}, "clean": nothing}
    any_left = not unique.isEmpty(), not unique.filter("reason IS NULL").isEmpty()
    got = {name: o.get if any_left[name == "clean"] else zeros.get(name, {"rows": 0}) for name, o in held.items()}
    before = got["read"]["rows"]
    left = [before, *(before if shared is None else before - got["shared"]["rows"] + got[k]["rows"] for k, _ in PASSES)]
    files = {k: spark.read.parquet(f"{path}/{k}").count() for k in ("unique", "clean", "rejected")}
    if (files["unique"], files["clean"]) != (left[-1], got["clean"]["rows"]) or files["rejected"] != left[-1] - files["clean"]:
        raise RuntimeError(f"the audit counted {left[-1]} and {got['clean']['rows']} rows, the files hold {files}: run it again")
    steps = [("read", "rows", left[0]), ("trim", "cells", got["read"]["cells"]), ("parse", "rows without a date", got["parse"]["undated"])]
    steps += [("deduplicate", k, a - b) for k, a, b in zip(("identical rows", "same transaction id", "same business key"), left, left[1:], strict=False)]
    steps += [("reject", r, got["reject"][r]) for r in REASONS] + [("repair", r, got["clean"][r]) for r in REPAIRS] + [("reconcile", c, got["clean"][c]) for c in off[:3]]
    steps += [("write", k, files[k]) for k in ("clean", "rejected")]
    rows = [(k + 1, *s) for k, s in enumerate(steps)]
    return spark.createDataFrame(rows, AUDIT), {"raw": left[0], "unique": left[-1], **got["clean"]}


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    return audited(dirty(spark, sf_dir), *masters(spark, sf_dir), f"{shared_dir(spark)}/clean-{uuid.uuid4().hex[:12]}")


def c19_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of the cleaning did to how many rows."""
    return _audited(spark, sf_dir)[0]


def c19_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what came in, what stayed, and its totals, as the run observed them."""
    t = _audited(spark, sf_dir)[1]
    schema = "raw_rows long, duplicates long, rejected_rows long, clean_rows long, rows_with_reconciliation_error long, first_date date, last_date date, total_revenue decimal(28,2), total_cost decimal(28,2), total_profit decimal(28,2)"
    row = (t["raw"], t["raw"] - t["unique"], t["unique"] - t["rows"], t["rows"], t["had_reconciliation_error"], t["first"], t["last"], t["revenue"], t["cost"], t["profit"])
    out = spark.createDataFrame([row], schema)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("total_revenue", "total_cost", "total_profit")})
    return out.select(
        "raw_rows", "duplicates", "rejected_rows", "clean_rows", rounded(F.col("clean_rows") * 100 / F.nullif(F.col("raw_rows"), F.lit(0))).alias("retention_rate_pct"), "rows_with_reconciliation_error",
        "first_date", "last_date", "total_revenue", "total_cost", "total_profit", rounded(F.col("total_profit") / F.nullif(F.col("total_revenue"), F.lit(0.0)) * 100).alias("gross_margin_pct"),
    )


def _r(x: str, n: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(24,6)), {n}) AS DOUBLE)"


_FIRST = lambda source, keys: f"SELECT * EXCLUDE once FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY seq) AS once FROM {source}) x WHERE once = 1"
_ALL = ("transaction_id", "transaction_date", "customer_id", "product_id", "region", *LABELS, *NUMBERS)
_HITS = "transaction_date IS NULL|transaction_date < DATE '{0}'|transaction_date > DATE '{1}'|quantity <= 0|quantity > {2}|unit_price <= 0|unit_price > {3}|discount < 0 OR discount > 1|product_id IS NULL".format(FIRST_DAY, LAST_DAY, MAX_QUANTITY, MAX_PRICE).split("|")
#: The same steps as SQL for the checking engine, written with windows and CASE instead of aggregates and flags.
CLEAN_SQL = f"""WITH parsed AS ({PARSED_SQL}), once1 AS ({_FIRST('parsed', _ALL)}), once2 AS ({_FIRST('once1', ('transaction_id',))}), once3 AS ({_FIRST('once2', BUSINESS_KEY)}),
unique_rows AS (SELECT *, {REASON_SQL} AS reason FROM once3),
looked AS (SELECT u.* EXCLUDE (reason, region, customer_segment, product_category), COALESCE(u.region, r_name) AS region, COALESCE(customer_segment, upper(c_mktsegment)) AS customer_segment, COALESCE(product_category, upper(p_type)) AS product_category, p_retailprice, p_partkey,
   u.product_category IS NULL AND p_type IS NOT NULL AS fixed_category, u.region IS NULL AND r_name IS NOT NULL AS fixed_region, u.customer_segment IS NULL AND c_mktsegment IS NOT NULL AS fixed_segment
  FROM unique_rows u LEFT JOIN part ON u.product_id = concat('P', CAST(p_partkey AS STRING)) LEFT JOIN customer ON u.customer_id = concat('CUST-', lpad(CAST(c_custkey AS STRING), 5, '0')) LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE reason IS NULL),
solved AS (SELECT * EXCLUDE (unit_price, unit_cost), unit_price AS price0, unit_cost AS cost0, COALESCE(unit_price, CASE WHEN quantity > 0 AND quantity * (1 - COALESCE(discount, 0)) > 0 THEN revenue / (quantity * (1 - COALESCE(discount, 0))) END) AS price1, COALESCE(unit_cost, CASE WHEN quantity > 0 THEN cost / quantity END) AS cost1 FROM looked),
middle AS (SELECT product_id, median(price1) AS p_price, median(cost1) AS p_cost FROM solved GROUP BY 1),
priced AS (SELECT s.*, COALESCE(price1, p_price, p_retailprice) AS unit_price, COALESCE(cost1, p_cost, {_r('p_retailprice * 0.9', 4)}) AS unit_cost FROM solved s LEFT JOIN middle m ON m.product_id = s.product_id),
segments AS (SELECT customer_segment, median(discount) AS s_discount FROM priced GROUP BY 1), dealt AS (SELECT p.* EXCLUDE discount, p.discount AS discount0, COALESCE(p.discount, s_discount) AS discount1 FROM priced p LEFT JOIN segments s ON s.customer_segment = p.customer_segment),
filled AS (SELECT seq, transaction_id, transaction_date, COALESCE(customer_id, 'UNATTRIBUTED') AS customer_id, CAST(CASE WHEN customer_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS is_customer_attributed, product_id, COALESCE(region, 'Unknown') AS region, product_category, COALESCE(customer_segment, 'Unknown') AS customer_segment, COALESCE(payment_type, 'Unknown') AS payment_type,
   quantity, unit_price, unit_cost, COALESCE(discount1, (SELECT median(discount1) FROM dealt)) AS discount, revenue, COALESCE(cost, unit_cost * quantity) AS cost, profit, fixed_category, fixed_region, fixed_segment, price0 IS NULL AND price1 IS NOT NULL AS fixed_price_solved, cost0 IS NULL AND cost1 IS NOT NULL AS fixed_cost_solved,
   price1 IS NULL AND unit_price IS NOT NULL AS fixed_price_median, cost1 IS NULL AND unit_cost IS NOT NULL AS fixed_cost_median, discount0 IS NULL AS fixed_discount, payment_type IS NULL AS fixed_payment, customer_id IS NULL AS fixed_customer, region IS NULL AS fixed_region_unknown, customer_segment IS NULL AS fixed_segment_unknown FROM dealt),
g AS (SELECT *, {_r('quantity * unit_price')} AS gross_revenue FROM filled), h AS (SELECT *, {_r('gross_revenue * discount')} AS discount_amount FROM g), n AS (SELECT *, {_r('gross_revenue - discount_amount')} AS r, {_r('quantity * unit_cost')} AS c FROM h), w AS (SELECT *, {_r('r - c')} AS p FROM n),
clean AS (SELECT seq, transaction_id, transaction_date, customer_id, is_customer_attributed, product_id, region, product_category, customer_segment, payment_type, quantity, unit_price, unit_cost, discount, r AS revenue, c AS cost, p AS profit, gross_revenue, discount_amount,
   COALESCE(abs(revenue - r) > {TOLERANCE}, false) AS revenue_off, COALESCE(abs(cost - c) > {TOLERANCE}, false) AS cost_off, COALESCE(abs(profit - p) > {TOLERANCE}, false) AS profit_off, revenue AS reported_revenue, {_r('revenue - r')} AS revenue_variance, CASE WHEN r > 0 THEN {_r('p / r * 100', 4)} END AS profit_margin_pct,
   {_r('unit_price * (1 - discount) - unit_cost', 4)} AS unit_margin, CASE WHEN r > 0 THEN {_r('c / r', 4)} END AS cost_to_revenue_ratio, CAST(p < 0 AS BIGINT) AS is_loss_making, COALESCE(abs(revenue - r) > {TOLERANCE}, false) OR COALESCE(abs(cost - c) > {TOLERANCE}, false) OR COALESCE(abs(profit - p) > {TOLERANCE}, false) AS had_reconciliation_error FROM w)"""

QUERIES = {"c01_parsed": c01_parsed, "c01_trimmed": c01_trimmed, "c11_rejections": c11_rejections, "c11_rule_hits": c11_rule_hits, "c12_quarantined": c12_quarantined, "c13_repaired": c13_repaired, "c18_clean": c18_clean, "c19_audit": c19_audit, "c19_summary": c19_summary}
_COUNT = lambda place, step, detail, sql: f"SELECT {place} AS place, '{step}' AS step, '{detail}' AS detail, CAST(({sql}) AS BIGINT) AS rows_affected"
_STEPS = [("read", "rows", "SELECT COUNT(*) FROM parsed"), ("trim", "cells", f"SELECT {' + '.join(f'COALESCE(SUM(CASE WHEN {c} <> trim({c}) THEN 1 ELSE 0 END), 0)' for c in _ALL)} FROM ({_DIRT_DUCK}) d"), ("parse", "rows without a date", "SELECT COUNT(*) FROM parsed WHERE transaction_date IS NULL")]
_STEPS += [("deduplicate", k, f"(SELECT COUNT(*) FROM {a}) - (SELECT COUNT(*) FROM {b})") for k, a, b in (("identical rows", "parsed", "once1"), ("same transaction id", "once1", "once2"), ("same business key", "once2", "once3"))]
_STEPS += [("reject", r, f"SELECT COUNT(*) FROM unique_rows WHERE reason = '{r}'") for r in REASONS] + [("repair", r, f"SELECT COUNT(*) FROM filled WHERE fixed_{r}") for r in REPAIRS]
_STEPS += [("reconcile", c, f"SELECT COUNT(*) FROM clean WHERE {c}") for c in ("revenue_off", "cost_off", "profit_off")] + [("write", "clean", "SELECT COUNT(*) FROM clean"), ("write", "rejected", "SELECT COUNT(*) FROM unique_rows WHERE reason IS NOT NULL")]
ORACLES = {
    "c19_audit": CLEAN_SQL + " " + " UNION ALL ".join(_COUNT(k + 1, *s) for k, s in enumerate(_STEPS)),
    "c01_parsed": PARSED_SQL,
    "c01_trimmed": " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(SUM(CASE WHEN {c} <> trim({c}) THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM ({_DIRT_DUCK}) d" for c in _ALL),
    "c11_rejections": f"SELECT {REASON_SQL} AS reason, COUNT(*) AS rows FROM ({PARSED_SQL}) p GROUP BY 1",
    "c11_rule_hits": CLEAN_SQL + " " + " UNION ALL ".join(f"SELECT '{r}' AS reason, CAST(SUM(CASE WHEN {hit} THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM unique_rows" for r, hit in zip(REASONS, _HITS, strict=True)),
    "c12_quarantined": CLEAN_SQL + " SELECT * FROM unique_rows WHERE reason IS NOT NULL",
    "c13_repaired": CLEAN_SQL + " " + " UNION ALL ".join(f"SELECT '{r}' AS repair, CAST(SUM(CASE WHEN fixed_{r} THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM filled" for r in REPAIRS),
    "c18_clean": CLEAN_SQL + " SELECT * FROM clean",
    "c19_summary": CLEAN_SQL + f""", t AS (SELECT COUNT(*) AS clean_rows, CAST(SUM(CAST(had_reconciliation_error AS BIGINT)) AS BIGINT) AS bad, MIN(transaction_date) AS first_date, MAX(transaction_date) AS last_date, CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS r, CAST(SUM(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) AS c, CAST(SUM(CAST(profit AS DECIMAL(18,2))) AS DOUBLE) AS p FROM clean),
x AS (SELECT (SELECT COUNT(*) FROM parsed) AS raw_rows, COUNT(*) AS kept, COUNT(reason) AS rejected_rows FROM unique_rows)
SELECT raw_rows, raw_rows - kept AS duplicates, rejected_rows, clean_rows, {_r('clean_rows * 100.0E0 / raw_rows')} AS retention_rate_pct, bad AS rows_with_reconciliation_error, first_date, last_date, r AS total_revenue, c AS total_cost, p AS total_profit, {_r('p / r * 100')} AS gross_margin_pct FROM t CROSS JOIN x""",
}
