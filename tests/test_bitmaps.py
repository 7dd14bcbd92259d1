"""Sets of customers by bitmap against Python's sets."""

import random

from pyspark.sql import functions as F

from ledgerspark.plans import bitmaps


def test_sets_of_years(spark):
    rng = random.Random(4)
    rows = [(rng.choice([2001, 2002, 2004, 2005]), rng.choice([rng.randint(0, 50), rng.randint(0, 200_000), 10**12 + rng.randint(0, 5)])) for _ in range(3000)] + [(2004, None)]
    df = spark.createDataFrame(rows, "year long, id long")
    sets = {}
    for y, i in rows:
        if i is not None:
            sets.setdefault(y, set()).add(i)
    years = bitmaps.bitmaps(df, "id", "year")
    assert dict(map(tuple, bitmaps.counted(years, "year").collect())) == {y: len(s) for y, s in sets.items()}
    assert {(r.year, r.before, r.retained) for r in bitmaps.retention(years).collect()} == {(y + 1, len(s), len(s & sets.get(y + 1, set()))) for y, s in sets.items()}
    seen, new = set(), {}
    for y in sorted(sets):
        new[y] = len(sets[y] - seen)
        seen |= sets[y]
    assert dict(map(tuple, bitmaps.newcomers(years).collect())) == new
    none = bitmaps.bitmaps(df.limit(0), "id", "year")
    assert bitmaps.retention(none).count() == bitmaps.newcomers(none).count() == 0


def test_names_become_dense_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("é",)], "k string")
    assert {(r.k, r.id) for r in bitmaps.dense(df, "k").collect()} == {("a", 1), ("b", 2), ("é", 3)}
    own = bitmaps.bitmaps(bitmaps.dense(df, "k"), "id")
    assert bitmaps.counted(own).first().n == 3 and own.select(F.length("bits")).first()[0] == 4096
