"""A folder's import with its manifest, and the drift of sources."""

import hashlib
import json

from factloom.operators import versions
from factloom.sources import folders


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_a_folder_is_imported_once(spark, tmp_path):
    box, store = tmp_path / "in box", str(tmp_path / "store")
    box.mkdir()
    (box / "sub").mkdir()
    (box / "odd.pdf").mkdir()
    files = {"b.pdf": b"%PDF b", "a.PDF": b"%PDF b", "c.json": b"{}", "d.pdf": b"no pdf", "e.pdf": b"", "f.pdf": b"%PDF f", "notes.txt": b"x", "model_responses.json": b"{}", "sub/g.pdf": b"%PDF g", "odd.pdf/h.pdf": b"%PDF h"}
    for name, data in files.items():
        (box / name).write_bytes(data)
    (box / "manifest.json").write_text(json.dumps([{"file": "b.pdf", "kind": "kyc"}, {"file": "f.pdf", "kind": "no kind"}, {"file": "d.pdf", "kind": "kyc"}, {"file": "d.pdf", "kind": "financials"}, {"file": "gone.pdf", "kind": "kyc"}]))
    told = {r.filename: r for r in folders.import_folder(spark, store, 7, str(box)).collect()}
    assert {n: (r.media_type, r.kind, r.kind_basis, r.is_new, r.same_as) for n, r in told.items()} == {
        "a.PDF": ("application/pdf", "other", None, True, "a.PDF"),
        "b.pdf": ("application/pdf", "kyc", "Set when added.", False, "a.PDF"),
        "c.json": ("application/json", "itr_json", "JSON file.", True, "c.json"),
        "d.pdf": ("application/octet-stream", "financials", "Set when added.", True, "d.pdf"),
        "e.pdf": ("application/octet-stream", "other", None, True, "e.pdf"),
        "f.pdf": ("application/pdf", "no kind", "Set when added.", False, None),
    }
    assert told["f.pdf"].refusal == "unknown document kind no kind" and told["a.PDF"].byte_size == 6
    stored = {r.filename: r for r in versions.read(spark, store).collect()}
    assert {n: (r.sha256, bytes(r.content), r.case_id) for n, r in stored.items()} == {n: (sha(files[n]), files[n], 7) for n in ("a.PDF", "c.json", "d.pdf", "e.pdf")}
    again = folders.import_folder(spark, store, 7, str(box))
    assert again.where("is_new").count() == 0 and versions.current(spark, store)["number"] == 1
    assert folders.import_folder(spark, store, 8, str(box)).where("is_new").count() == 4 and versions.read(spark, store).count() == 8
    empty = tmp_path / "empty"
    empty.mkdir()
    assert folders.import_folder(spark, store, 7, str(empty)).count() == 0 and versions.read(spark, store).count() == 8


def test_sources_drift_and_come_back(spark):
    q = "quote_and_link"
    documents = spark.createDataFrame([(1, q, "a", None, None), (2, q, "a", 5, "b"), (3, q, "a", 5, "b"), (4, "full", "a", None, None), (5, q, "a", 5, "b"), (6, q, "a", 5, "b"), (7, q, "a", None, None), (8, q, "a", None, None), (9, None, "a", None, None)], "document_id long, policy string, sha256 string, source_changed_at int, source_changed_sha256 string")
    fetched = spark.createDataFrame([(1, 9, "b"), (2, 9, "a"), (3, 9, "c"), (4, 9, "b"), (5, 9, None), (7, 9, "a"), (8, 8, "b"), (8, 9, "a"), (9, 9, "b"), (99, 9, "b")], "document_id long, fetched_at int, sha256 string").repartition(3)
    got = {r.document_id: (r.drift, r.source_changed_at, r.source_changed_sha256) for r in folders.drift(documents, fetched).collect()}
    assert got == {1: ("changed", 9, "b"), 2: ("matches again", None, None), 3: ("changed", 5, "c"), 4: (None, None, None), 5: ("not fetched", 5, "b"), 6: (None, 5, "b"), 7: (None, None, None), 8: (None, None, None), 9: (None, None, None)}
