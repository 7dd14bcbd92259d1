"""The pipeline against brute force, stage by stage, on the smallest tables."""

import hashlib

import numpy as np

import corpus_pipeline
from ledgerspark.llm import bpe

from .test_operators import slow_fingerprint

D = "/root/testdata/sf0.001"


def shingles(t):
    w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, labels = docs.columns, dict(spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "bpe"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = dict(docs.select("doc_id", "text").collect())
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            assert all(before[r.doc_id] == r.text for r in docs.collect())
        kept.append({r.doc_id for r in docs.collect()})
        if k == 0:
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in kept[0] for i in clean) >= 0.9 * len(clean)
        elif k == 1:
            assert kept[1] == {max(j for j in before if before[j] == t) for t in before.values()}
        elif k == 2:
            fp, left = {i: slow_fingerprint(t) for i, t in before.items()}, set(before)
            want = set()
            while left:
                group, todo = set(), [min(left)]
                while todo:
                    x = todo.pop()
                    group.add(x)
                    left.discard(x)
                    near = {y for y in left if (fp[x] ^ fp[y]).bit_count() <= 3}
                    left -= near
                    todo += near
                want.add(min(group))
            assert kept[2] == want
        elif k == 3:
            items = [shingles(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            own = {i: shingles(t) for i, t in before.items()}
            assert kept[3] == {i for i, s in own.items() if not any(b and len(b & s) >= 0.8 * len(b) - 1e-9 for b in items)}
        else:
            lib = Tokenizer.from_file(bpe.default_path())
            for r in docs.collect():
                assert r.ids_sha256 == hashlib.sha256(np.array(lib.encode(before[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert len(kept[4]) == corpus_pipeline.run(spark, D).count()


def test_toxic_documents_go(spark, tmp_path):
    """The toxicity stage on documents with planted passages, from few labels and from more."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 8))) for _ in range(300)]
    for n in (200, 800):
        rows = [(i, " ".join([*rng.choice(pool, 60), *(["vile", "wretch"] * (i % 5 == 0)), *rng.choice(pool, 30)])) for i in range(n)]
        at = str(tmp_path / str(n))
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, n) if i % 2 or i % 10 == 0], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
        kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()}
        toxic, clean = range(0, n, 5), [i for i in range(n) if i % 5]
        assert sum(i in kept for i in toxic) <= 0.2 * len(toxic), n
        assert sum(i in kept for i in clean) >= 0.9 * len(clean), n
