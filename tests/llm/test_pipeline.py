"""The pipeline's stages on a small table with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.3 else f"word{rng.randint(0, 9999)}"
    text = lambda n: "\n".join(" ".join(word() for _ in range(20)) for _ in range(n))
    item = " ".join(f"item{k} of" for k in range(15))
    clean = [text(6) for _ in range(30)]
    near = [w + "zz" if k == 77 else w for k, w in enumerate(clean[0].split())]
    near = "\n".join(" ".join(near[k : k + 17]) for k in range(0, len(near), 17))  # wrapped anew
    rows = clean + [clean[1], near, text(3) + "\n" + item, "bad", "spam " * 100, clean[2] + "\n" + clean[3].split("\n")[0]]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(rows)] + [(None, text(4), None, None, None), (99, None, "en", "s", 0)]
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    ids = lambda n: set(kept[n])
    assert ids("quality_rules") == {*range(33), 35, None}
    assert ids("line_dedup") == {*range(30), 31, 32, None}  # 30 is a copy; every line of 35 stands earlier
    assert kept["line_dedup"][5] == kept["quality_rules"][5]
    assert all(r.n_chars in (None, len(r.text)) for r in kept["line_dedup"].values() if r.doc_id is not None)
    assert ids("near_duplicates") == ids("line_dedup") - {31}
    assert ids("decontamination") == ids("near_duplicates") - {32}
    assert ids("encoding") == ids("decontamination") and all(r.n_tokens == len(r.ids) for r in kept["encoding"].values())
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {d: r.ids_sha256 for d, r in kept["encoding"].items()}


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
