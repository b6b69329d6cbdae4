"""The pipeline on the small test tables: what each stage keeps and drops."""

import corpus_pipeline as p
from factloom.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs, before = table(spark, SF, "documents"), None
    sizes = []
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == p.COLUMNS
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert before is None or set(ids) <= before, name
        before = set(ids)
        sizes.append(len(ids))
    assert sizes[1] < sizes[0] and sizes[1] == sizes[2] > sizes[3] > 0
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == before and all(r.n_tokens == len(r.token_ids) for r in last)


def test_copies_of_one_id_or_of_none_are_one_document(spark):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, texts[0], "en", "b"), (1, texts[0], "en", "a"), (1, texts[1], "en", "a"), (2, texts[0], "en", "a"), (None, texts[2], "en", "a"), (None, texts[2], "en", "a"), (None, texts[1], "en", "a"), (3, None, "en", "a"), (3, None, "en", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r)[:4] for r in p.keep_distinct(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[2], rows[4], rows[6], rows[7]], key=str)
