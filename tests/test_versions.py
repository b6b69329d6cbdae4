"""Tables that change whole or not at all, a killed load, builds of what changed, and snapshots that prove themselves."""

import os
import subprocess
import sys
import tempfile
import textwrap
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.operators import proofs, versions

CLAIMS = "claim_id long, document_id long, value string"
ANCHORS = "claim_id long, document_id long, char_start int, char_end int, evidence_text string"


@pytest.fixture
def root():
    return "file://" + tempfile.mkdtemp(prefix="factloom-versions-") + "/table"


def rows(spark, root):
    return sorted(tuple(r) for r in versions.read(spark, root).select("claim_id", "document_id", "value").collect())


def claims(spark, *given):
    return spark.createDataFrame(list(given), CLAIMS)


def anchors(spark, *ids):
    return spark.createDataFrame([(i, d, 0, 5, "hello") for i, d in ids], ANCHORS)


def texts(spark, n=300):
    return spark.createDataFrame([(d, "hello world") for d in range(n)], "document_id long, text string")


def load(spark, root, *given, unproved=()):
    ids = [(c, d) for c, d, _ in given if c not in unproved]
    return {r.document_id: r.reason for r in versions.load_claims(spark, root, claims(spark, *given), anchors(spark, *ids), texts(spark)).collect()}


def test_loads_replace_documents_whole_or_not_at_all(spark, root):
    many = [(k, k % 200, "old") for k in range(400)]
    assert load(spark, root, *many) == {} and len(rows(spark, root)) == 400
    first = versions.current(spark, root)
    assert load(spark, root, (1001, 7, "new"), (1002, 9, "new"), (1003, 9, "bare"), unproved=(1003,)) == {9: "unanchored"}
    got = rows(spark, root)
    assert [r for r in got if r[1] == 7] == [(1001, 7, "new")] and [r for r in got if r[1] == 9] == [(9, 9, "old"), (209, 9, "old")] and len(got) == 399
    second = versions.current(spark, root)
    moved = {k for k in second["buckets"] if second["buckets"][k] != first["buckets"].get(k)}
    assert second["number"] == 2 and len(moved) == 1  # only the touched bucket was written
    assert load(spark, root, (1003, 9, "bare"), unproved=(1003,)) == {9: "unanchored"} and versions.current(spark, root)["number"] == 2


def test_a_check_that_finds_rows_leaves_the_table(spark, root):
    load(spark, root, (1, 1, "old"))
    with pytest.raises(versions.Refused):
        versions.replace(spark, root, "document_id", claims(spark, (2, 1, "new")), lambda old: claims(spark, (2, 1, "new")), old_schema(spark), check=lambda written: written.where("value = 'new'"))
    assert rows(spark, root) == [(1, 1, "old")]
    gone = versions.sweep(spark, root)
    assert len([g for g in gone if g.startswith("data/")]) == 1 and rows(spark, root) == [(1, 1, "old")]


def old_schema(spark):
    return claims(spark, (0, 0, "")).schema


def test_a_load_that_is_overtaken_fails(spark, root):
    load(spark, root, (1, 1, "old"))
    before = versions.current(spark, root)
    staged = versions.stage(claims(spark, (2, 1, "mine")), root, "document_id")
    load(spark, root, (3, 1, "theirs"))
    with pytest.raises(versions.Overtaken):
        versions.switch(spark, root, before, old_schema(spark), staged)
    assert rows(spark, root) == [(3, 1, "theirs")]


def test_a_load_killed_between_its_data_and_its_version_leaves_the_old_table(spark, root):
    load(spark, root, (1, 1, "old"), (2, 2, "old"))
    killed = textwrap.dedent(f"""
        import os
        from factloom.session import local_session
        from factloom.operators import versions
        versions.switch = lambda *given: os._exit(9)  # dies where the data is written and the version is not
        spark = local_session(1)
        kind = "claim_id long, document_id long, value string"
        new = spark.createDataFrame([(5, 1, "new")], kind)
        versions.replace(spark, {root!r}, "document_id", new, lambda old: new, new.schema)
    """)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", killed], cwd=here, env=os.environ | {"PYTHONPATH": here}, capture_output=True, timeout=300, check=False)
    assert done.returncode == 9, done.stderr[-2000:]
    assert rows(spark, root) == [(1, 1, "old"), (2, 2, "old")]
    assert load(spark, root, (5, 1, "new")) == {} and rows(spark, root) == [(2, 2, "old"), (5, 1, "new")]
    assert len([g for g in versions.sweep(spark, root) if g.startswith("data/")]) == 1 and rows(spark, root) == [(2, 2, "old"), (5, 1, "new")]


def test_derived_tables_are_rebuilt_and_reset(spark, root):
    assert versions.reset(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.rebuild(claims(spark, (1, None, "x"), (2, 5, "y")), root, "document_id") == 1
    versions.rebuild(claims(spark, (3, 6, "z")), root, "document_id")
    assert rows(spark, root) == [(3, 6, "z")] and versions.reset(spark, root) == 3 and rows(spark, root) == []


def test_only_cases_whose_inputs_changed_are_built_again(spark, root):
    facts = [(1, "a", 5), (1, "a", 5), (2, "b", None), (3, "c", 7)]
    notes = [(2, "seen"), (None, "lost")]
    frame = lambda f, n: {"facts": spark.createDataFrame(f, "case_id long, name string, amount int").repartition(3), "notes": spark.createDataFrame(n, "case_id long, note string")}
    built = []

    def build(inputs):
        built.append(sorted(r.case_id for r in inputs["facts"].select("case_id").distinct().collect()))
        return inputs["facts"].groupBy("case_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))

    def run(f, n):
        told = versions.build_changed(spark, root, "case_id", frame(f, n), build)
        return sorted((r.case_id, r.gone) for r in told.collect()), sorted(tuple(r) for r in versions.read(spark, root).collect())

    assert run(facts, notes) == ([(1, False), (2, False), (3, False)], [(1, 2, 10), (2, 1, None), (3, 1, 7)])
    assert run(list(reversed(facts)), notes)[0] == [] and built[-1] == []
    # a repeated row, a changed note, a case that is gone, a new one
    told, now = run([facts[0], (2, "b", None), (4, "d", 1)], [(2, "seen again")])
    assert told == [(1, False), (2, False), (3, True), (4, False)] and now == [(1, 1, 5), (2, 1, None), (4, 1, 1)] and built[-1] == [1, 2, 4]
    assert run([facts[0], (2, "b", 0), (4, "d", 1)], [(2, "seen again")])[0] == [(2, False)]


FACTS = "fact_id long, case_id long, document_id long, page_no int, spans array<struct<start:int,stop:int>>, evidence_text string, json_path string, value_num decimal(20,2), value_text string, verified boolean"


def test_snapshots_prove_what_they_publish(spark, root):
    pages = spark.createDataFrame([(1, 1, "gross pay 90,000.00 net"), (1, 2, "other")], "document_id long, page_no int, text string")
    documents = spark.createDataFrame([(2, '{"itr": {"rows": [{"total": 700000}, {"name": "ACME"}]}}')], "document_id long, raw string")
    cases = spark.createDataFrame([(1, True), (2, False)], "case_id long, synthetic boolean")
    good = [
        (1, 1, 1, 1, [(0, 5), (10, 19)], "gross 90,000.00", None, None, None, True),
        (2, 1, 2, None, None, None, "itr.rows.0.total", Decimal("700000.00"), None, True),
        (3, 1, 2, None, None, None, "itr.rows.1.name", None, "ACME Ltd", True),
        (4, 1, 1, 2, None, "a quote nobody found", None, None, "x", False),
    ]
    frame = lambda given: spark.createDataFrame(given, FACTS).repartition(2)
    told = {r.fact_id: r.verdict for r in proofs.proofs(frame(good), pages, documents).collect()}
    assert told == {1: "proved", 2: "proved", 3: "proved", 4: "shown"}
    assert proofs.publish(frame(good), pages, documents, cases, root) == 1 and versions.read(spark, root).count() == 4
    bad = [
        (5, 1, 1, 2, [(0, 5)], "gross", None, None, None, True),
        (6, 1, 1, 9, [(0, 5)], "gross", None, None, None, True),
        (7, 1, 2, None, None, None, "itr.rows.0.total", Decimal("1.00"), None, True),
        (8, 1, 3, None, None, None, "itr", None, "x", True),
        (9, 1, 1, 1, None, None, None, None, "x", True),
        (10, 2, 1, 1, None, None, None, None, "see /Users/me/file", False),
    ]
    assert {r.fact_id: r.verdict for r in proofs.proofs(frame(bad), pages, documents).collect()} == {5: "the page does not say it", 6: "no such page", 7: "the path does not hold it", 8: "no such document", 9: "verified without an anchor", 10: "shown"}
    reasons = {(r.what, r.id): r.reason for r in proofs.refusals(frame(good + bad), pages, documents, cases).collect()}
    assert reasons["case", 2] == "not a synthetic case" and reasons["fact", 10] == "says where it is stored" and len(reasons) == 7
    with pytest.raises(versions.Refused):
        proofs.publish(frame(good + bad), pages, documents, cases, root)
    assert versions.read(spark, root).count() == 4
