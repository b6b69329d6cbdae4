"""The pipeline's stages on nulls, empty texts, repeated rows, empty tables and columns beyond those of documents."""

import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
ROWS = [(900001, None, "a"), (900002, "", "b"), (900003, "One short text.", "c"), (900003, "One short text.", "c"), (None, "Another short text.", "d"), (None, None, "e")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "x", [1], "y") for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, token_ids array<int>, __digest string").repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_an_empty_table_gives_an_empty_one(spark, docs, name):
    assert dict(p.STAGES)[name](spark, docs.limit(0), SF).count() == 0


def test_stages_keep_rows_of_any_kind(spark, docs):
    told = sorted((str(r[0]), str(r[1])) for r in ROWS)
    seen = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    scored = p.keep_good(spark, docs, SF)
    assert scored.columns == p.COLUMNS and set(seen(scored)) <= set(told)
    assert seen(p.keep_distinct(spark, docs, SF)) == sorted(set(told))
    assert seen(p.cut_repeats(spark, docs, SF)) == told
    assert seen(p.drop_contaminated(spark, docs, SF)) == told
    coded = p.tokenize(spark, docs, SF)
    assert coded.count() == len(ROWS) and coded.where("n_tokens = 0").count() == 3 and set(coded.columns) == {"doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"}
