"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline as cp
import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(300):
        said = rng.choices(words, k=60)
        toxic, bad = i % 6 == 0, i % 7 == 0
        if toxic:
            for _ in range(6):
                said[rng.randrange(60)] = rng.choice(["scoundrel", "scoundrels"])
        if bad:
            said = [w + "%%%" for w in said]
        rows.append((i, " ".join(said), "en", f"src{i % 4}", 0))
        if i < 250:
            labels.append((i, int(not bad), int(toxic)))
    clean = [r for r in rows if r[0] % 6 and r[0] % 7]
    for k, r in enumerate(clean[:20]):  # exact and near copies
        said = r[1].split()
        if k % 2:
            said[30] = "changed"
        rows.append((1000 + k, " ".join(said), "en", "src9", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (None, "just a few plain words here", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == cp.COLUMNS
        left[name] = [r.doc_id for r in docs.collect()]
    ids = set(left["toxicity"])
    assert not [i for i in ids if i is not None and i < 300 and i % 6 == 0] and len([i for i in range(300) if i % 6 and i not in ids]) <= 5
    ids = set(left["quality classifier"])
    assert not [i for i in ids if i is not None and i < 300 and i % 7 == 0]
    ids = left["MinHash near-dedup"]
    assert not [i for i in ids if i is not None and 1000 <= i < 2000] and len(ids) == len(set(ids)) and None in ids
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.where("piece = 0").count() == docs.count()
