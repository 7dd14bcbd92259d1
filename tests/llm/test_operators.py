"""The corpus operators against brute force, on small tables with nulls, empties, ties, copies and clashing columns."""

import functools
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, common, decontaminate, exact_dedup, extract, quality, sampling, sharding, simhash, suffix_dedup, toxicity, url_filter
from tests.llm.layouts import LAYOUTS

R = random.Random(3)
WORDS = [("".join(R.choice("abcdefghiklmnoprstu") for _ in range(R.randint(2, 8)))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, score double, n long, keep_id long"


def say(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@functools.cache
def corpus():
    passage, base = say(60), say(120)
    texts = [None, "", "   ", "a", "one two", base, base, base + " x", base.upper(), say(3000), passage + " " + say(50), say(40) + "\n" + passage, "é" * 150, "é" * 150 + "!", "ab" * 400]
    texts += [say(R.randint(1, 150)) for _ in range(40)] + [base] * 6
    return [(i * 3, t, "en", 0.5, 7, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, nothing):
    got = {r.doc_id: r for r in exact_dedup.label(docs).collect()}
    rows = corpus()
    for i, t, *_ in rows:
        same = [j for j, u, *_ in rows if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
    assert exact_dedup.label(nothing).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t, *_ in rows})


def test_index_takes_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, "digest_index_of_a_test", 4)
    index.drop()
    one = spark.createDataFrame([(1, "a"), (2, "b"), (4, "b"), (3, None)], "doc_id long, text string")
    two = spark.createDataFrame([(5, "a"), (6, "a"), (7, "c"), (8, ""), (9, "c")], "doc_id long, text string")
    rows = lambda df: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}
    assert rows(exact_dedup.label(one, index)) == {1: (1, 1, True), 2: (4, 2, False), 4: (4, 2, True), 3: (3, 1, True)}
    assert rows(exact_dedup.label(two, index)) == {5: (1, 3, False), 6: (1, 3, False), 7: (9, 2, False), 9: (9, 2, True), 8: (3, 2, False)}
    keepers = exact_dedup.digests(two).groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    plan = index.new_of(keepers)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and index.new_of(keepers).count() == 0
    index.append(exact_dedup.digests(one.limit(0)))
    assert index.rows().count() == 4
    index.drop()
    before = [t.name for t in spark.catalog.listTables()]
    exact_dedup.label(docs)
    exact_dedup.keep_first(docs)
    assert [t.name for t in spark.catalog.listTables()] == before


def slow_fingerprint(text):
    raw = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def check_classes(rows, got):
    fp = {i: slow_fingerprint(t) for i, t, *_ in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {i: f & (1 << 64) - 1 for i, (f, _) in got.items()} == fp
    assert {i: c for i, (_, c) in got.items()} == {i: find(i) for i in ids}


def test_simhash(docs, nothing):
    check_classes(corpus(), {r.doc_id: (r.fp, r.component_id) for r in simhash.classes(docs).collect()})
    assert simhash.classes(nothing).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


def groups_of(n, pairs):
    """The least member of each node's group."""
    out = list(range(n))
    while True:
        before = list(out)
        for a, b in pairs:
            out[a] = out[b] = min(out[a], out[b])
        if out == before:
            return out


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(8)
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 470)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")).collect()}
    want = groups_of(900, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


def test_simhash_links_of_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 2)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")).collect()}
    every = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3}
    assert got <= every and groups_of(len(fps), got) == groups_of(len(fps), every)
    # copies that share a segment with a pivot near to all of them: one link each
    near = [base[0]] + [base[0] ^ (1 << i) for i in range(32)]
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(list(zip(signed, range(len(near)), strict=True)), "fp long, rep long")).collect()}
    assert len(set(groups_of(len(near), got))) == 1 and len(got) == 32


def test_suffix_dedup(spark, docs, nothing):
    for size in (1500, 1 << 20):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs, size).collect()]
        assert sorted(got) == suffix_dedup.brute_force([(i, t) for i, t, *_ in corpus()])
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert sorted({(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == list(range(suffix_dedup.V))


def test_heads_of_long_stretches():
    rng = np.random.default_rng(1)
    for n in (73, 74, 500, 1000, 1999):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        assert (suffix_dedup.heads(keys, 200) == suffix_dedup.heads(keys)).all() and len(suffix_dedup.heads(keys, 200)) == n


def test_bpe_equals_the_library(spark, docs, nothing):
    from tokenizers import Tokenizer

    hard = ["a  b", "x   y\n  z \n", "a \n b  ", "\n \n", "don't I'll  'S", "<|endoftext|>hi <|endoftext|>  there", "a" * 3000, "日本語 テキスト 🙂👍🏽", "tab\t x \t\ty 12 345,67", " lead", "trail ", "ab" * 2000, "\u00a0 x\u3000 y"]
    own = spark.createDataFrame([(1000 + i, t, "", 0.0, 0, 0) for i, t in enumerate(hard)], SCHEMA).union(docs)
    lib = Tokenizer.from_file(bpe.default_path())
    rows = {r.doc_id: r for r in bpe.encode(own, bpe.default_path(), full=True).collect()}
    for r in own.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.ids == ids and got.n_tokens == len(ids)
        assert got.decoded == lib.decode(ids, skip_special_tokens=False)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(got.decoded.encode()).hexdigest()
    assert bpe.encode(nothing, bpe.default_path()).count() == 0


def test_lexicon_is_exact(tmp_path):
    words = sorted({w.encode() for w in WORDS} | {w.encode() + b"ing" for w in WORDS})
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(words, [np.array([i, i + 1], "<u4").tobytes() for i in range(len(words))]))
    lex = bpe.Lexicon(str(tmp_path / "x"))
    assert lex.find(words).tolist() == list(range(len(words)))
    assert (lex.find([b"zzzzzz", b"", words[0] + b"q", words[5][:-1] + b"~"]) == -1).all()


def test_sharding(spark, docs, nothing):
    own = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("link"))
    rows = sharding.shard(own, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(corpus()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    shards = {}
    for r in rows:
        shards.setdefault(r.link, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.shard(nothing.select("doc_id", F.col("text").alias("link"))).count() == 0


def test_decontamination(spark, docs, nothing):
    rows = corpus()
    passage = next(t for i, t, *_ in rows if i == 30).split()[:40]
    items = [(0, " ".join(passage)), (1, " ".join(passage[:36]) + " never met words"), (2, " ".join(passage[:20]) + " " + say(20)), (3, None), (4, ""), (5, "one two"), (6, " ".join(passage).upper() + "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(d, i) for d, t, *_ in rows for i, u in items if shingles(u) and len(shingles(u) & shingles(t)) >= 0.8 * len(shingles(u)) - 1e-9}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, bench).collect()} == want and want
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, *_ in rows} - {d for d, _ in want}
    assert decontaminate.contained(nothing, bench).count() == decontaminate.contained(docs, bench.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/x?y", "http://a.example.com/fr/", "http://x.net/es/1", "http://x.net/fr/1#a", "http://x.net/de/1", "http://com", "nothing", None, "http://xcom/en/", "http://h?/en/", "a://b://c/d"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(6)] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None]
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "allow", "block", "block"]
    assert (got[0].host, got[0].path) == ("example.com", "/en/1") and (got[6].host, got[6].path, got[6].rule) == ("com", "", None)
    assert [(got[i].host, got[i].path) for i in (7, 8)] == [("", ""), ("", "")] and (got[10].host, got[10].path) == ("h", "") and (got[11].host, got[11].path) == ("b:", "//c/d")
    many = [(i, f"http://h{i}.net/{'es' if i % 2 else 'fr'}/casino/{i}") for i in range(60)] + [(1000 + i, f"http://g{i}.com/de/news/{i}") for i in range(60)] + [(2000, "http://z.org/xx/casino/9"), (2001, "http://z.org/xx/news/9"), (2002, "http://z.org/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert (got[2000].verdict, got[2001].verdict, got[2002].verdict) == ("block", "allow", "allow") and got[2000].mined


@pytest.fixture(scope="module")
def labeller(spark):
    return extract.fit(spark.read.parquet(f"/root/testdata/sf0.001/pages.parquet"))


def test_extraction_of_layouts(labeller):
    """Hand-labelled pages of layouts with and without names: F1 over blocks."""
    found = [set(t.split("\n")) - {""} for t in extract.extract_text([page for _, page, _ in LAYOUTS], labeller)]
    wanted = [set(text.split("\n")) - {""} for _, _, text in LAYOUTS]
    hit = sum(len(f & w) for f, w in zip(found, wanted, strict=True))
    assert 2 * hit / (sum(map(len, found)) + sum(map(len, wanted))) >= 0.95
    assert hit / sum(map(len, wanted)) >= 0.98


def test_extraction(spark, labeller):
    page = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li><a href=x>Home</a><li><a>More</a></ul></nav><article><h1>A &amp; B</h1><p>First  text\n here, with some words.<p>Second &lt;one&gt; follows it.</article><aside>Side</aside><footer>&copy; me</footer>"
    net = labeller
    assert extract.extract_text([page, None, "", "<nav>x</nav>"], net) == ["A & B\nFirst text here, with some words.\nSecond <one> follows it.", "", "", ""]
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (2, "v", "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.n_chars) for r in extract.extract(df, net).collect()) == [(1, len("A & B\nFirst text here, with some words.\nSecond <one> follows it.")), (2, 0), (2, 0)]


def test_scores(spark, docs, nothing):
    rows = [(i, (say(40) + (" vile wretch" * 2 if i % 3 == 0 else "") + " " + say(20)) if i % 7 else "$$$ " * 20 + "vile wretch " * (i % 3 == 0)) for i in range(600)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0), int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r.score for r in quality.score(own, quality.fit(own, labels)).collect()}
    assert np.mean([(q[i] >= 0.3) == (i % 7 > 0) for i in q]) > 0.97
    net = toxicity.fit(own, labels)
    t = {r.doc_id: r.score for r in toxicity.score(own, net).collect()}
    assert np.mean([(t[i] >= 0.5) == (i % 3 == 0) for i in t]) > 0.95
    clean = toxicity.keep_clean(docs, net)
    assert clean.columns == docs.columns
    for model, module in ((quality.fit(nothing, labels), quality), (toxicity.fit(nothing, labels), toxicity)):
        got = module.score(docs, model).collect()
        assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, net).count() == 0 and quality.score(nothing, quality.fit(own, labels)).count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    own = spark.createDataFrame([(i, "x") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = sampling.labelled(own, labels, "toxic", 1000)
    assert got.filter(sampling.held_out(F.col("doc_id"))).count() == 0 and got.count() > 100


def test_toxicity_reads_the_whole_of_long_runs():
    rng = random.Random(4)
    for run in ("x" * 100, "aé日🙂" * 40, ",".join(WORDS), "_".join(WORDS), "=" * 90, "日本語、テキスト" * 30, "".join(WORDS)):
        at, parts = 0, toxicity.pieces(run)
        for p in parts:
            found = run.rfind(p, 0, at + len(p))
            assert 0 <= found <= at, "a piece starts past the last one's end"
            at = max(at, found + len(p))
        assert at == len(run) and all(len(p.encode()) <= 4 * toxicity.LONG for p in parts)
    assert toxicity.words("a b,c " + "/".join(WORDS[:20])) == ["a", "b,c", *(w + "/" for w in WORDS[:19]), WORDS[19]]
    raw = [toxicity.bare(w) for w in ("ab" * 30 + "cd", "", "a", "Abc.", "abc")]
    for n in toxicity.GRAMS:
        flat, count = toxicity.ngrams(raw, n)
        assert count.tolist() == [len(r) - n + 1 for r in raw] and count[0] == 64 - n + 1 and len(flat) == count.sum()
        by = {}
        for gram, at in zip([r[i : i + n] for r in raw for i in range(len(r) - n + 1)], flat, strict=True):
            assert by.setdefault(gram, at) == at
    texts = [" ".join(rng.choice(WORDS) for _ in range(40)) + (" vile wretch " * 2 if i % 3 == 0 else " ") + " ".join(rng.choice(WORDS) for _ in range(20)) for i in range(600)]
    net = toxicity.learn(texts, np.array([int(i % 3 == 0) for i in range(600)]))
    for sep in (",", "_", "/"):
        clean, toxic = sep.join(WORDS[:60]), sep.join([*WORDS[:30], "vile", "wretch", "vile", "wretch", *WORDS[30:60]])
        a, b = net.score_texts([clean, toxic]) - net.shift
        assert a < 0 < b


def test_toxicity_threshold_does_not_move_with_the_sample():
    rng = np.random.default_rng(2)
    logit, truth = np.r_[rng.normal(0, 1, 60), rng.normal(2.5, 1, 20)], np.repeat([0, 1], [60, 20])
    cut = toxicity.best_cut(logit, truth)
    for zeros, ones in ((7, 7), (30, 1), (1, 30)):  # more rows, other shares
        assert toxicity.best_cut(*(np.concatenate([np.tile(a[truth == 0], zeros), np.tile(a[truth == 1], ones)]) for a in (logit, truth))) == pytest.approx(cut)
    assert (logit[truth == 0] >= cut).mean() <= toxicity.CLEAN_LOSS and (logit[truth == 1] >= cut).mean() > 0.5
    texts = [say(5) for _ in range(40)] * 2
    y = np.arange(80) % 4 // 3
    fold = toxicity.folds(texts, y)
    assert all(len(set(fold[[i, i + 40]])) == 1 for i in range(40)) and all(0 < y[fold == k].sum() < 10 for k in range(toxicity.FOLDS))


def test_toxicity_learns_from_every_window(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join([*(rng.choice(WORDS) for _ in range(rng.randint(300, 900))), *["vile", "wretch"] * (i % 4 == 0), *(rng.choice(WORDS) for _ in range(300))]) for i in range(240)]
    y = np.array([int(i % 4 == 0) for i in range(240)])
    met, train = [], toxicity.Network.train
    monkeypatch.setattr(toxicity.Network, "train", lambda net, at, y, vocabulary, *rest: (met.append((at, y, vocabulary)), train(net, at, y, vocabulary, *rest)))
    net = toxicity.learn(texts[:160], y[:160])
    for at, label, vocabulary in met[: toxicity.TURNS]:  # windows called toxic hold the passage
        ids = [vocabulary.ids["vile"], vocabulary.ids["wretch"]]
        assert np.isin(at[label > 0], ids).any(axis=1).mean() > 0.9
    logit = net.score_texts(texts[160:]) - net.shift
    assert (logit[y[160:] == 1] >= 0).mean() >= 0.9 and (logit[y[160:] == 0] < 0).mean() >= 0.9


def test_repeated_rows_and_rows_without_an_id(spark, tmp_path):
    base = say(80)
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, "c"), (None, "c"), (None, None), (None, base), (None, base + " x"), (7, base)] + [(i, say(9)) for i in range(20, 90)]
    rows = [(i, t, n) for n, (i, t) in enumerate(rows)]
    own = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    own.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op3_sharding(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(s, ())) for s in range(sharding.SHARDS)) <= 1
    facts = sorted((-1 if i is None else i, len((t or "").encode()) + 8) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == facts
    once = own.filter("n NOT IN (1, 2, 4)")  # ids that are there are unique
    left = exact_dedup.keep_first(once)
    kept = left.collect()
    assert left.columns == own.columns and len(kept) == len({r.text or "" for r in kept}) == len({t or "" for _, t, n in rows if n not in (1, 2, 4)})
    assert {(r.doc_id, r.text) for r in kept} >= {(2, "a"), (7, base), (None, "c"), (None, None)}
    left = simhash.keep_first(once)
    kept = left.collect()
    fp = {n: slow_fingerprint(t) for _, t, n in rows}
    assert left.columns == own.columns and sum(r.doc_id is None for r in kept) >= 1
    assert all((fp[r.n] ^ fp[q.n]).bit_count() > 3 for r in kept for q in kept if r.n < q.n)
    assert all(any((fp[n] ^ fp[r.n]).bit_count() <= 3 for r in kept) for _, _, n in rows if n not in (1, 2, 4))
    bench = spark.createDataFrame([(1, " ".join(base.split()[:30]))], "item_id long, text string")
    left = decontaminate.remove_contaminated(once, bench)
    assert left.columns == own.columns and {r.n for r in left.collect()} == {n for _, t, n in rows if n not in (1, 2, 4) and not (t or "").startswith(base)}


def test_extraction_reads_on_after_missing_end_tags():
    read = lambda page: [b[0] for b in extract.blocks(page)]
    main = "<article><p>One two.<p>Three <b>four</b>.</article>"
    want = ["One two.", "Three four."]
    assert read("<datalist><option value=a></datalist>" + main) == want
    assert read("<div><select><option>a<option>b</div>" + main)[-2:] == want
    for tag in ("button", "select", "svg", "iframe", "template", "noscript", "option"):
        assert read(f"<nav><{tag}>Menu</nav>{main}")[-2:] == want
        assert read(f"<{tag}>{main}")[-2:] == want
        assert read(f"<nav><{tag}>Menu</nav>{main}<nav><{tag}>x</{tag}></nav>")[-2:] == want
        assert read(f"<p>a <{tag}>x y</{tag}> b</p>{main}") == ["a b", *want]
    for tag in ("svg", "iframe", "template", "noscript", "select"):
        assert read(f"<p>a <{tag}><div>x</div><p>y</{tag}> b</p>{main}") == ["a b", *want]
    assert read(f"<button>Menu{main}<button>OK</button>")[1:] == want
    assert read(f"<button>{main}</button>") == want
    for tag in ("script", "style", "title", "textarea"):
        assert read(f"<p>a</p><{tag}>x{main}") == ["a"] and read(f"<{tag}><p>x</{tag}>{main}") == want
