"""The pipeline's stages against brute force, each on what the stage before kept."""

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_jaccard import brute as linked
from test_packing import check

from jsonloom.llm import language, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            check(list(kept.items()), out.collect(), 2048)
            break
        assert out.columns == docs.columns
        if name == "language_id":
            want = {i: t for i, t in kept.items() if language.LETTER.search(t or "")}
        elif name == "near_duplicates":
            want = {i: kept[i] for i, _, c in linked(list(kept.items()), 5, (80, 100)) if i == c}
        elif name == "decontamination":
            want = {i: kept[i] for i, _, _, found in contaminated(list(kept.items()), items) if not found}
        else:
            again = {(r.kind, r.form): r.attempt for r in pii.exceptions(pii.written(pii.entity_table(docs), "entities"), pii.key_of(spark)).collect()}
            want = {i: pii.rewritten(t, pii.key_of(spark), again)[0] for i, t in kept.items()}
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id: r.text for r in out.collect()} == want, name
        docs, kept = out, want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["some words", None, "", "²½", "日本"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [0, 4]


def test_language_is_kept(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "der hund lief in den wald", ("en" if i % 2 else "de") if i < 40 else None, "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id % 2, r.lang) for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {(0, "de"), (1, "en")}
