"""Token counts, resampling and alignment against brute force; rows that share or lack an id; mined url rules."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerspark.llm import align, bpe, exact_dedup, extract, pieces, quality, resample, simhash, suffix_dedup, toxicity, url_filter
from ledgerspark.operators.order import ranked

from .test_operators import SCHEMA, corpus, slow_fingerprint

R = random.Random(11)
BITS = ["a", "b", " ", "  ", "the", "ing", "é", "日", "\n", "<s>", "\x00", "😀", "ﬁ", "1", "\t", "z" * 70, "</s>", "<|endoftext|>", "\r\n", " " * 20, " ", "\n ", "'s", "<0x0A>"]
BIG = (1 << 53) + 1
ODD = "doc_id long, text string"


def odd_texts(n=400):
    own = ["".join(R.choice(BITS) for _ in range(R.randint(0, 25))) for _ in range(n)]
    return [None, "", " ", "▁", "a▁b", "x" * 50_000 + " y", "word " * 30_000, *own, *own[:20], *(t for _, t, *_ in corpus())]


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (None, None), (BIG, "large id"), (7, "an id met before")]
    return spark.createDataFrame([(i, t, "en", 0.5, 7, 1) for i, t in rows], SCHEMA).repartition(3), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_token_counts(odd, nothing):
    import sentencepiece

    docs, rows = odd
    read = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    want = [(i, len((t or "").encode()), n := len(read.encode(t or "")), n > 4096) for i, t in rows]
    got = pieces.count_tokens(docs, pieces.default_path())
    assert plain(map(tuple, got.collect())) == plain(want)
    assert pieces.count_tokens(nothing, pieces.default_path()).count() == 0


def test_proofs_of_the_piece_vocabulary():
    import sentencepiece

    own = pieces.Pieces(pieces.default_path())
    read = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    some = R.sample(sorted(p for p in own.whole if p[0] == "▁" and p.strip("▁")), 2000)
    assert all(read.encode(p[1:]) == [own.pieces[p]] for p in some)
    parts, first = own.parts(["▁the,日", "▁the"])
    assert "".join(parts) == "▁the,日▁the" and parts[first[1]] == "▁the"
    ids = own.encode([" the,日", " " * 21 + "x"])
    assert np.frombuffer(ids[0], "<u4").tolist() == read.encode("the,日") and np.frombuffer(ids[1], "<u4").tolist() == read.encode(" " * 20 + "x")


def slow_weights(texts, target, lo, hi, m):
    def runs(t):
        raw = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        w = [x for x in "".join(chr(c) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else " " for c in raw).split(" ") if x]
        w = [x.encode("latin-1") for x in w]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % m for k in range(lo, hi + 1) for i in range(len(w) - k + 1)]

    own, theirs = [runs(t) for t in texts], [runs(t) for t in target]
    s, t = Counter(b for _, r in own for b in r), Counter(b for _, r in theirs for b in r)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + m) / ((s[b] + 1) * (t.total() + m)))) for b in set(s)}
    return [(n, len(r), sum(gain[b] for b in r)) for n, r in own]


@pytest.mark.parametrize(("lo", "hi", "m", "percent"), [(1, 1, 10_000, 10), (1, 3, 50, 35), (2, 2, 7, 100)])
def test_resampling(spark, odd, nothing, lo, hi, m, percent):
    docs, rows = odd
    target = spark.createDataFrame([("The Word zz the",), (None,), ("x",)], "text string")
    want = []
    for (i, _), (n, k, w) in zip(rows, slow_weights([t for _, t in rows], ["The Word zz the", None, "x"], lo, hi, m), strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, k, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    pool = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    place = defaultdict(list)
    for k, r in enumerate(pool):
        place[r].append(k + 1 if k < percent * len(pool) // 100 else None)
    full = [(i, k, w, s, place[i, n, k, w, s].pop() if n >= 20 else None) for i, n, k, w, s in want]
    assert plain(map(tuple, resample.resample(docs, target, percent, 20, lo, hi, m).collect())) == plain(full)
    assert resample.resample(nothing, target, percent, 20, lo, hi, m).count() == 0
    assert resample.resample(docs, target.limit(0), percent, 20, lo, hi, m).count() == len(rows)


def slow_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    lib, read, letters = Tokenizer.from_file(bpe.default_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path()), bpe.byte_letters()
    lib.encode_special_tokens = True
    docs, counts, most = [], Counter(), defaultdict(int)
    for t in texts:
        found = None
        if t:
            a, b = lib.encode(" " + t, add_special_tokens=False).ids, read.encode(t)
            raw_a = [bytes(letters[c] for c in lib.id_to_token(i)) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if read.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [read.id_to_piece(i)]]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                end_a, end_b = list(itertools.accumulate(map(len, raw_a))), list(itertools.accumulate(map(len, raw_b)))
                links, i, j = [], 0, 0
                while i < len(a) and j < len(b):
                    links.append((a[i], b[j]))
                    x, y = end_a[i], end_b[j]
                    i, j = i + (x <= y), j + (y <= x)
                both, groups, i, j = sorted(set(end_a) & set(end_b)), [], 0, 0
                for e in both:
                    p, q = end_a.index(e, i) + 1, end_b.index(e, j) + 1
                    groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                    i, j = p, q
                found = (len(a), len(b), groups, links)
                counts.update(set(links))
        docs.append(found)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n = [counts[x] for x in d[3]]
            yield (d[0], d[1], len(d[2]), len(d[3]), sum(k == most[a] for k, (a, _) in zip(n, d[3], strict=True)), sum(n), hashlib.sha256(";".join(d[2]).encode()).hexdigest())


def test_alignment(odd, nothing):
    docs, rows = odd
    want = plain((i, *r) for (i, _), r in zip(rows, slow_alignment([t for _, t in rows]), strict=True))
    paths = bpe.default_path(), pieces.default_path()
    assert plain(map(tuple, align.alignment(docs, *paths).collect())) == want
    assert plain(map(tuple, align.alignment(docs, *paths, max_mapped=0).collect())) == want  # counts joined by a shuffle
    assert align.alignment(nothing, *paths).count() == 0 and align.alignment(nothing, *paths, max_mapped=-1).count() == 0


def test_products_of_sparse_rows():
    dense = [np.array([[1, 0, 2], [0, 0, 0], [3, 1, 0]]), np.array([[0, 1], [4, 0], [5, 6]])]

    def rows(m):
        at = [np.flatnonzero(r) for r in m]
        return align.Rows(np.cumsum([0, *map(len, at)]), np.concatenate(at), np.concatenate([r[k] for r, k in zip(m, at, strict=True)]))

    got = align.product(*map(rows, dense), 2)
    out = np.zeros((3, 2), int)
    out[align.rows_of(got), got.columns] = got.values
    assert (out == dense[0] @ dense[1]).all()
    pair = align.Pair(bpe.Vocabulary(bpe.default_path()), pieces.Pieces(pieces.default_path()))
    overlap, shared = align.links("  hello wörld", pair)
    assert set(x[:2] for x in overlap) <= set(shared) and sum(n for *_, n in overlap) == len("   hello wörld".encode())


def test_ranks(spark):
    rows = [(R.randint(0, 5), R.randint(0, 50), k) for k in range(500)] + [(None, None, -1)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = ranked(df, df.a.desc_nulls_last(), df.b.asc_nulls_last(), df.c.asc()).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or 0, r[2]))
    assert {tuple(r)[:3]: r["rank"] for r in got} == {r: k + 1 for k, r in enumerate(want)}
    assert ranked(df.limit(0), df.a.asc()).count() == 0


def test_rows_that_share_or_lack_an_id(spark, odd):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "a"), (None, "c"), (None, "c"), (BIG, None), (3, "")], ODD)
    assert sorted(r.text or "" for r in exact_dedup.keep_first(docs).collect()) == ["", "a", "b", "c"]
    assert {(r.doc_id, r.text) for r in exact_dedup.keep_first(docs).collect()} == {(1, "b"), (2, "a"), (None, "c"), (BIG, None)}
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (2, "some other text of its own"), (2, "yet another one that is not alike"), (None, base), (BIG, "far")], ODD)
    left = [tuple(r) for r in simhash.keep_first(docs).collect()]
    assert len(left) == len(set(slow_fingerprint(t) for _, t in left)) == 4 and (1, base) in left
    named = {(r.doc_id, r.fp): r.component_id for r in simhash.classes(docs).collect()}
    assert len({v for v in named.values()}) == 3 and named[2, int(np.int64(np.uint64(slow_fingerprint(base))))] == 1


def test_ids_keep_their_value_beside_missing_ones(spark):
    ids = [BIG, None, 5]
    docs = spark.createDataFrame([(i, "some text that is long enough " * 8) for i in ids], ODD).coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = lambda df, c="doc_id": sorted((r[c] for r in df.collect()), key=lambda x: (x is None, x)) == [5, BIG, None]
    assert same(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert same(quality.score(docs, quality.fit(docs, labels)))
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[5] < removed[BIG] == removed[None] == 240
    pages = spark.createDataFrame([(i, "u", "<p>x</p>") for i in ids], "page_id long, url string, html string").coalesce(1)
    assert same(extract.extract(pages, extract.learn(["<article><p>text of a page</p></article><nav>menu</nav>"])), "page_id")


def slow_verdicts(urls):
    """Rules over up to three tokens, by all combinations; urls are (tokens, label or None)."""
    total, counts = sum(v is not None for _, v in urls), defaultdict(Counter)
    for tokens, v in urls:
        if v is not None:
            for k in range(1, 4):
                for c in itertools.combinations(sorted(set(tokens)), k):
                    counts[c][v] += 1
    least = max(math.ceil(total / 100), 8)
    rules = [((n + 1) / (c.total() + 2), n, v, set(t)) for t, c in counts.items() for v, n in c.items() if c.total() >= least and n >= least and (n + 1) / (c.total() + 2) >= 0.9]
    return [max(((p, n, says) for p, n, says, t in rules if t <= set(tokens)), default=(0, 0, "allow"))[2] for tokens, _ in urls]


def test_mined_rules(spark):
    seg = ["es", "fr", "casino", "news", "win", "sport", "a1", "b"]
    urls = [f"http://{R.choice(['x', 'y', 'z'])}{R.randint(1, 9)}.{R.choice(['net', 'net', 'com', 'org'])}/{'/'.join(R.sample(seg, R.randint(1, 5)))}" for _ in range(600)]
    df = spark.createDataFrame([*enumerate(urls), (None, None)], "page_id long, url string")
    own = url_filter.parts(df)
    tokens = [(r.t, r.f.verdict if r.f else None) for r in own.orderBy("page_id").select(url_filter.tokens(own.host, own.path).alias("t"), url_filter.fixed_rule(own.host, own.path).alias("f")).collect()]
    want = [label or says for says, (_, label) in zip(slow_verdicts(tokens), tokens, strict=True)]
    assert [r.verdict for r in url_filter.judge(df).orderBy("page_id").collect()] == want and {"block", "allow"} == set(want)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_shared_segments_do_not_multiply(spark):
    deep = "/".join(f"s{k}" for k in range(40))
    urls = [f"http://h.net/es/{deep}/{i}" for i in range(60)] + [f"http://g.org/{deep}/x", "http://g.org/other"]
    began = time.time()
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("page_id", "page_id")).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    assert got[urls[60]] == "block" and got[urls[61]] == "allow" and time.time() - began < 60
