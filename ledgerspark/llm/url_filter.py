"""URL filtering by fixed rules and by mined association rules.

Fixed rules are (host, path) pairs: a rule fits its host and all subdomains when the url's path starts with the
rule's path, and the longest rule wins. Where none fits, the verdict comes from association rules: FP-growth mines
token combinations of the urls that the fixed rules have labelled, together with their label; rules that reach the
least support and confidence are posted under their rarest item (an inverted index), a url fetches the postings of
its own items, and a fetched rule matches if the url holds all of its items. The most confident match decides;
on ties the rule with more support, then block before allow. A url that no rule matches is allowed.

FP-growth is written here as its recursion over conditional pattern bases, in DataFrame steps: Spark's own estimator has
no bound on a rule's length, so k tokens that many labelled urls share would cost 2^k combinations.

Defined cases: null urls and urls without "://" have empty host and path, no tokens, no rule and the verdict allow;
repeated rows are judged each, whatever their page_id, missing ones too; very long urls are read whole, and segments that
only occur together count as one item; no labelled url means no mined rules; an empty table gives an empty result;
columns other than the key and url are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, table

#: The contract's rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Least share of the labelled urls that a rule holds, least confidence, and how many items it combines at most.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.9, 3
#: Mined rules up to this number may be broadcast (each is at most MAX_TOKENS short tokens).
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = urls.withColumn("_rest", rest)
    return out.withColumns({
        "host": F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("_rest")


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last one to fit is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments, and the words of those that hold several; digits stand as one #."""
    plain = F.regexp_replace(path, r"[0-9]+", "#")
    labels, segments = F.split(host, r"\."), F.split(plain, "/")
    several = F.filter(F.concat(labels, segments), lambda x: x.rlike(r"[^\p{L}]"))
    inner = F.transform(F.flatten(F.transform(several, lambda x: F.split(x, r"[^\p{L}]+"))), lambda x: F.concat(F.lit("w:"), x))
    hosts = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    paths = F.transform(segments, lambda x: F.concat(F.lit("p:"), x))
    return F.filter(F.array_distinct(F.concat(hosts, paths, inner)), lambda x: F.length(x) > 2)


def known(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame, int, int]:
    """The labelled urls as (items, verdict, n), most frequent items first; (token, item) of the frequent tokens; the number
    of urls; and how many of them a rule must hold at least.

    Tokens that the labelled urls have in common throughout (the segments of one long path) are one item, named by its
    least token: rules over them could not differ. So no stretch of a path multiplies the rules.
    """
    kinds = cut(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(-(-total * int(min_support * 10_000) // 10_000), fewest(min_confidence))
    marks = [F.xxhash64(F.lit(seed), "tokens", "verdict").alias(f"mark{seed}") for seed in (1, 2)]
    each = kinds.select(F.explode("tokens").alias("token"), "verdict", "n", *marks)
    same = ["n", "mark1", "mark2"]
    frequent = cut(each.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("mark1").alias("mark1"), F.bit_xor("mark2").alias("mark2")).filter(F.col("n") >= least))
    items = cut(frequent.join(frequent.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", F.col("n").alias("often")))
    found = join_hot(each, items, "token", "often", total).groupBy("mark1", "mark2", "verdict", "n").agg(F.array_sort(F.collect_set(F.struct(-F.col("often"), "item"))).alias("items"))
    rows = found.groupBy(F.col("items.item").alias("items"), "verdict").agg(F.sum("n").alias("n"))
    return rows, items.select("token", "item"), total, least


def fewest(min_confidence: float) -> int:
    """The least number of urls whose rule can be confident enough, should they all agree."""
    n = 1
    while (n + 1) / (n + 2) < min_confidence:
        n += 1
    return n


def mine(rows: DataFrame, total: int, least: int, min_confidence=MIN_CONFIDENCE, max_tokens=MAX_TOKENS) -> DataFrame:
    """(items, verdict, confidence, support) of the rules that remain: FP-growth over conditional pattern bases, cut at max_tokens items.

    A base is held as rows (pattern, the more frequent items before it, verdict, number of urls), equal rows merged as in
    a prefix tree. A step grows each frequent pattern by each item before it, so every combination comes about once.
    confidence is (hits + 1) / (urls + 2): of rules that always hold, those of more urls are surer.
    """
    base = rows.select(F.array().cast("array<string>").alias("pattern"), F.col("items").alias("before"), "verdict", "n")
    out = None
    for _ in range(max_tokens):
        each = base.select("pattern", "before", "verdict", "n", F.posexplode("before").alias("at", "item"))
        pattern = F.array_append("pattern", F.col("item")).alias("pattern")
        grown = cut(each.select(pattern, F.slice("before", F.lit(1), F.col("at")).alias("before"), "verdict", "n").groupBy("pattern", "before", "verdict").agg(F.sum("n").alias("n")))
        block = F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0))
        stats = cut(grown.groupBy("pattern").agg(F.sum("n").alias("urls"), block.alias("block"), F.count("*").alias("rows")).filter(F.col("urls") >= least))
        sides = F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), k.alias("hits")) for v, k in (("block", F.col("block")), ("allow", F.col("urls") - F.col("block"))))))
        found = stats.select("pattern", "urls", sides.alias("s")).select(
            F.array_sort("pattern").alias("items"), "s.verdict", ((F.col("s.hits") + 1) / (F.col("urls") + 2)).alias("confidence"), (F.col("s.hits") / total).alias("support")
        ).filter((F.col("confidence") >= min_confidence) & (F.col("support") * total >= least - 0.5))
        out = found if out is None else out.unionByName(found)
        base = join_hot(grown.filter(F.size("before") > 0), stats.select("pattern", "rows"), "pattern", "rows", grown.count()).drop("rows")
    return out


def post(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Each rule under its rarest item."""
    each = rules.withColumn("rule_id", F.concat_ws(" ", "items")).withColumn("item", F.explode("items"))
    rarest = each.join(counts, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    return rules.withColumn("rule_id", F.concat_ws(" ", "items")).join(rarest, "rule_id")


def judge(urls: DataFrame, key: str = "page_id", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, and what the mined rules say where no fixed rule fits."""
    own = parts(urls.select(key, "url"))
    own = own.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    labelled = own.filter(F.col("fixed").isNotNull()).select("tokens", F.col("fixed.verdict").alias("verdict"))
    if labelled.isEmpty():
        empty = F.lit(None).cast("string")
        return own.select(key, "host", "path", empty.alias("rule"), F.lit("allow").alias("verdict"), empty.alias("mined"), F.lit(None).cast("double").alias("confidence"))
    rows, items, n_labelled, least = known(labelled)
    rows = cut(rows)
    mined = cut(mine(rows, n_labelled, least))
    counts = rows.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))
    posted = cut(post(mined, counts)).select("item", F.col("items").alias("needs"), F.col("verdict").alias("says"), "confidence", "support")
    if posted.count() <= BROADCAST_RULES:
        posted = F.broadcast(posted)
    if items.count() <= BROADCAST_RULES:
        items = F.broadcast(items)
    # Urls with the same tokens have the same answer: one search for each kind.
    kinds = cut(own.filter(F.col("fixed").isNull()).groupBy("tokens").agg(F.count("*").alias("n")))
    held = kinds.select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))
    fetched = held.withColumn("item", F.explode("items")).join(posted, "item")
    matches = fetched.filter(F.forall("needs", lambda t: F.array_contains("items", t)))
    best = matches.groupBy("tokens").agg(
        F.max(F.struct("confidence", "support", "says", F.concat_ws(" ", "needs").alias("needs"))).alias("best")
    )
    fixed = own.filter(F.col("fixed").isNotNull()).select(key, "host", "path", "fixed.rule", "fixed.verdict", F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence"))
    # A kind of url may hold a third of all rows; such kinds meet their answer by broadcast.
    answers = kinds.join(best, "tokens", "left")
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    free = join_hot(own.filter(F.col("fixed").isNull()), answers, "tokens", "n", total).select(
        key, "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("best.says", F.lit("allow")).alias("verdict"), F.col("best.needs").alias("mined"), "best.confidence"
    )
    return fixed.unionByName(free)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
