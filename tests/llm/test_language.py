from jsonloom.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = {r.doc_id: r for r in language.digests(docs).collect()}
    rows = [r for r in docs.collect() if found[r.doc_id].held_out]
    right = sum(found[r.doc_id].lang_pred == r.lang for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_defined_results(spark, odd, none):
    found = {(r.doc_id, r.text): r for r in language.identified(odd, language.fitted(odd)).collect()}
    text = {i: t for i, t in found}
    assert all(r.lang_pred == "und" and r.score == 0 for (i, t), r in found.items() if not language.LETTER.search(t or ""))
    assert {r.lang_pred for (i, t), r in found.items() if language.LETTER.search(t or "")} <= {"en", "de"}
    assert text[9] == "12345 !!"
    assert language.fitted(none) is None
    assert {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}
    assert language.identified(none, language.fitted(odd)).count() == 0
    one = spark.createDataFrame([(1, "abc def", "xx")], "doc_id long, text string, lang string")
    assert language.identified(one, language.fitted(one)).first().lang_pred == "xx"


def test_letters_labels_and_names(spark):
    made = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 4} word{i % 160}", f"l{i % 160}", 0.5) for i in range(640)]
    docs = spark.createDataFrame([*made, (1000, "²½ ② Ⅷ", None, 0.1), (1001, "ª", None, 0.1)], "doc_id long, text string, lang string, score double")
    done = language.identified(docs, language.fitted(docs, sample=4))
    assert done.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = {r.doc_id: r.lang_pred for r in done.collect()}
    assert found[1000] == "und" and found[1001] != "und"
    assert sum(found[i] == f"l{i % 160}" for i in range(640)) > 500


def test_against_brute_force(spark):
    """The same votes, counted one document and one pair at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fitted(docs)
    families = list(model.families.values())
    for r in language.identified(docs, model).collect():
        if not language.LETTER.search(r.text or ""):
            assert r.lang_pred == "und"
            continue
        x = language.vector(r.text)
        margins = [float(x @ w[:-1] + w[-1]) for w in model.by_family] or [0.0]
        f = margins.index(max(margins))
        votes = {}
        for g, i, j, w in model.by_pair:
            if g == f:
                m = float(x @ w[:-1] + w[-1])
                for k, won, margin in ((i, m > 0, m), (j, m <= 0, -m)):
                    v, s = votes.get(k, (0, 0.0))
                    votes[k] = (v + won, s + margin)
        best = max(votes, key=lambda k: (*votes[k], -k)) if votes else 0
        assert r.lang_pred == families[f][best]
