"""The audit of a cleaning run against direct counts."""

from ledgerspark.operators import cleaning

D = "/root/testdata/sf0.001"


def test_audit_counts_what_the_steps_do(spark, tmp_path):
    raw = cleaning.dirty(spark, D)
    raw = raw.unionByName(raw.filter("seq % 50 = 0")).unionByName(raw.filter("seq % 70 = 0").withColumn("seq", raw.seq + 10**9))
    found, totals = cleaning.audited(raw, *cleaning.masters(spark, D), str(tmp_path / "a"))
    rows = {(r.step, r.detail): r.rows_affected for r in found.collect()}
    own = dict(cleaning.passes(cleaning.parse(raw)))
    left = [raw.count(), *(own[k].count() for k in ("identical rows", "same transaction id", "same business key"))]
    assert rows["read", "rows"] == left[0]
    assert [rows["deduplicate", k] for k in own] == [a - b for a, b in zip(left, left[1:])] and rows["deduplicate", "identical rows"] > 0
    unique = cleaning.deduplicate(cleaning.parse(raw)).withColumn("reason", cleaning.rejection())
    reasons = {r.reason: r["count"] for r in unique.groupBy("reason").count().collect()}
    assert {r: rows["reject", r] for r in cleaning.REASONS} == {r: reasons.get(r, 0) for r in cleaning.REASONS}
    assert rows["write", "clean"] == reasons[None] == totals["rows"] and rows["write", "rejected"] == left[-1] - reasons[None]
    clean = spark.read.parquet(str(tmp_path / "a" / "clean"))
    assert clean.columns == cleaning.c18_clean(spark, D).columns and clean.filter("revenue_off").count() == rows["reconcile", "revenue_off"]
    assert [r.place for r in found.orderBy("place").collect()] == list(range(1, found.count() + 1))


def test_audit_of_nothing(spark, tmp_path):
    found, totals = cleaning.audited(cleaning.dirty(spark, D).limit(0), *cleaning.masters(spark, D), str(tmp_path / "b"))
    assert {r.rows_affected for r in found.collect()} == {0} and totals["rows"] == 0 and totals["revenue"] is None


def test_audit_of_rows_that_all_go(spark, tmp_path):
    raw = cleaning.dirty(spark, D).filter("seq % 101 = 0")  # the rule gives these a negative quantity
    found, totals = cleaning.audited(raw, *cleaning.masters(spark, D), str(tmp_path / "c"))
    rows = {(r.step, r.detail): r.rows_affected for r in found.collect()}
    assert rows["write", "clean"] == 0 == totals["rows"] and rows["write", "rejected"] == rows["read", "rows"] == raw.count() > 0


def test_audit_writes_rows_that_share_no_key_without_passes(spark, tmp_path):
    raw = cleaning.dirty(spark, D)
    raw = raw.unionByName(raw.filter("seq % 50 = 0")).unionByName(raw.filter("seq % 70 = 0").withColumn("seq", raw.seq + 10**9))
    cleaning.audited(raw, *cleaning.masters(spark, D), str(tmp_path / "d"))
    parsed, unique = (spark.read.parquet(str(tmp_path / "d" / k)) for k in ("parsed", "unique"))
    same = lambda df: sorted(map(str, df.select(*parsed.columns).collect()))
    assert same(parsed) == same(cleaning.parse(raw)) and same(unique) == same(cleaning.passes(cleaning.parse(raw))[-1][1])
    assert 0 < cleaning.parted(parsed)[1].count() < parsed.count() / 10


def test_audit_is_the_same_however_many_rows_share_a_key(spark, tmp_path, monkeypatch):
    alone = cleaning.dirty(spark, D).filter("seq % 3 = 0")
    raw = alone.unionByName(alone.filter("seq % 50 = 0")).unionByName(alone.filter("seq % 70 = 0").withColumn("seq", alone.seq + 10**9))
    run = lambda df, at: sorted(map(str, cleaning.audited(df, *cleaning.masters(spark, D), str(tmp_path / at))[0].collect()))
    few, none = run(raw, "e"), run(alone, "f")
    assert [r for r in none if "step='deduplicate'" in r and "rows_affected=0" not in r] == []
    monkeypatch.setattr(cleaning, "MARKS", 1)
    assert run(raw, "g") == few
