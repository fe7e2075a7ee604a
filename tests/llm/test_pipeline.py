"""The pipeline's stages on a small corpus, each held against what it must do to its own input."""

import hashlib

import corpus_pipeline
from deltaloom.llm import bpe, mixing, ngram_join, repeats
from deltaloom.llm.queries import vocabulary


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], source).write.parquet(str(tmp_path / str(n)))
        seen.append(spark.read.parquet(str(tmp_path / str(n))))
    assert all(d.columns == columns for d in seen[:-1])
    start, clean, single, cut, mixed, tokens = seen
    labels = spark.read.parquet(f"{source}/labels.parquet")
    lost = start.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert clean.count() < start.count() and lost.where("toxic = 0").count() <= 0.02 * start.count()
    groups = ngram_join.join(clean)
    assert single.count() == groups.select("class_id").distinct().count()
    assert ngram_join.join(single).where("n_links > 0").count() == 0
    removed = {r["doc_id"]: r for r in repeats.repeats(single, **corpus_pipeline.PASSAGES).collect()}
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert len(texts) == single.count()
    assert all(hashlib.sha256(texts[i].encode()).hexdigest() == r["kept_sha256"] for i, r in removed.items() if r["n_removed"] == 0)
    assert cut.where("n_chars <> length(text)").count() == 0
    taken = mixing.mix(cut).selectExpr("sum(taken) AS n").first()["n"]
    assert mixed.select(mixing.size_of(mixed["text"]).alias("size")).selectExpr("sum(size) AS n").first()["n"] == taken
    library = bpe.Bpe(vocabulary())
    assert tokens.count() == mixed.count()
    some = mixed.where("length(text) < 3000").first()
    ids = next(r["ids"] for r in tokens.where(tokens["doc_id"] == some["doc_id"]).collect())
    assert ids == library.piece(some["text"])
