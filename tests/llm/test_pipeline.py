"""The pipeline's stages one after the other on a small corpus, each held against what brute force would keep."""

import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages_end_to_end(spark, tmp_path):
    import corpus_pipeline as cp
    from marlstone.llm.common import DOC_COLUMNS

    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = text(40)
    rows, good = [], []
    for k in range(240):
        body = "notice of the site\n" + text(80) + "."
        good.append(body)
        rows.append((k, body))
    rows += [(300 + k, good[k]) for k in range(5)] + [(310, good[6] + " tail"), (320, text(20) + " " + item), (330, None), (331, "")]
    rows += [(400 + k, "BUY!! NOW!! " * (20 + k)) for k in range(60)]
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i % 2 == 0 and i not in (330,)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert tuple(docs.columns) == DOC_COLUMNS
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert not ids & set(range(400, 460)) and set(range(240)) <= ids
        elif name == "line_dedup":
            assert docs.where("text like '%notice of the site%'").count() == 0
        elif name == "near_dedup":
            assert not ids & {300, 301, 302, 303, 304, 310} and set(range(240)) <= ids
        else:
            assert 320 not in ids and set(range(240)) <= ids
    out = cp.STAGES[-1][1](spark, docs, d)
    assert out.count() == docs.count() and out.where("n_tokens is null").count() == 0
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, d).count() == 0
