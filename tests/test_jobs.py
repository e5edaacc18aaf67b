"""Fetching through a transport, jobs of a library, label indexes, digest stores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import checks
from stemma.operators import digest, embeddings, graph
from stemma.operators.library import Library
from stemma.sources import fetch, records
from stemma.sources.label_index import LabelIndex


def client(answers, waits=None):
    """A client of answers by URL; a list is given one by one."""
    asked = []

    def transport(url, params):
        asked.append((url, params))
        got = answers(url, params) if callable(answers) else answers[url]
        return got.pop(0) if isinstance(got, list) else got

    made = fetch.Client(transport, sleep=(waits if waits is not None else []).append)
    return made, asked


def test_retries():
    waits = []
    c, asked = client({"u": [fetch.Reply(429, headers={"Retry-After": "7"}), fetch.Reply(503), fetch.Reply(200, "ok")]}, waits)
    assert c.get("u") == "ok" and waits == [7.0, 6.0] and len(asked) == 3
    assert client({"u": fetch.Reply(404)})[0].get("u") is None
    with pytest.raises(OSError, match="400"):
        client({"u": fetch.Reply(400)})[0].get("u")
    waits.clear()
    with pytest.raises(OSError, match="500"):
        client({"u": fetch.Reply(500)}, waits)[0].get("u")
    assert len(waits) == fetch.RETRIES
    assert fetch.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", now=0) == 60.0 and fetch.retry_after("soon") is None


def test_pages():
    entry = "<entry><id>http://arxiv.org/abs/2401.0000{}v1</id><title>T{}</title></entry>"
    c, asked = client(lambda u, p: fetch.Reply(200, "<feed>" + "".join(entry.format(i, i) for i in range(p["start"], min(5, p["start"] + p["max_results"]))) + "</feed>"), [])
    assert len(list(fetch.atom_pages(c, "cat:cs.DB", page=2))) == 5 and [p["start"] for _, p in asked] == [0, 2, 4]
    assert len(list(fetch.atom_pages(c, "cat:cs.DB", page=2, limit=3))) == 3
    with pytest.raises(ValueError):
        fetch.atom_params()
    pages = {"*": (["a", "b"], "x"), "x": (["c"], "y"), "y": ([], "z")}
    c, asked = client(lambda u, p: fetch.Reply(200, json.dumps({"message": {"items": [{"DOI": i} for i in pages[p["cursor"]][0]], "next-cursor": pages[p["cursor"]][1]}})))
    assert [json.loads(x)["DOI"] for x in fetch.crossref_journal(c, "1-1", since="2020-01-01")] == ["a", "b", "c"] and asked[0][1]["filter"] == "from-pub-date:2020-01-01"
    assert fetch.filters("type:journal-article, issn:1-1") == "type:journal-article,issn:1-1" and fetch.filters(None) is None
    with pytest.raises(ValueError):
        fetch.filters("nothing")


def test_doi_chain(spark):
    def answers(url, params):
        if url.startswith(fetch.CROSSREF):
            return fetch.Reply(200, json.dumps({"message": {"DOI": "10.1/a", "title": ["A"]}})) if url.endswith("/a") else fetch.Reply(404)
        if url.startswith(fetch.ZENODO):
            return fetch.Reply(200, json.dumps({"metadata": {"title": "Z", "publication_date": "2020-01-02"}}))
        if url == f"{fetch.DOI}/10.1/b" and "accept" in params:
            return fetch.Reply(200, json.dumps({"title": "B", "publisher": "P"}))
        return fetch.Reply(404)

    got = fetch.doi_records(spark, client(answers)[0], ["10.1/a", "10.1/b", "10.5281/zenodo.7", "10.1/none"])
    assert {r.ref_id: (r.source, r.title) for r in got.collect()} == {"doi:10.1/a": ("crossref", "A"), "doi:10.1/b": ("doi_org_csl", "B"), "doi:10.5281/zenodo.7": ("zenodo", "Z")}
    assert fetch.atom_records(spark, client(lambda u, p: fetch.Reply(200, "<feed></feed>"))[0], search="x").count() == 0


def rows(spark, *given):
    names = "ref_id source source_id arxiv_version doi title".split()
    df = spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], "ref_id string, source string, source_id string, arxiv_version int, doi string, title string")
    return checks.align(df, records.SCHEMA)


def test_library(spark, tmp_path):
    a = {"ref_id": "arxiv:2401.00001", "source": "arxiv", "source_id": "2401.00001", "arxiv_version": 1, "doi": "10.1000/A", "title": "one"}
    batches = [rows(spark, a), rows(spark, a | {"arxiv_version": 2, "title": "two"}, {"ref_id": "arxiv:2401.00002", "source": "arxiv", "source_id": "2401.00002"}), rows(spark)]
    asked = []

    def fetcher(row, first, last):
        asked.append((row["collection_id"], first, last))
        return batches.pop(0)

    config = {"collections": [{"collection_id": "c", "title": "C", "remote_channel": "r", "collection_type": "t", "local_path": "p"}]}
    lib = Library(spark, str(tmp_path), config, {"r": fetcher})
    assert lib.sync("c") == 1 and lib.sync_all() == {"c": 2} and lib.repair_journal("c", "2024-01-01", "2024-01-31") == 0
    assert asked[0] == ("c", None, None) and asked[1][1] is not None and asked[2] == ("c", "2024-01-01", "2024-01-31")
    assert {r.ref_id: r.title for r in lib.read_journal("c").collect()} == {"arxiv:2401.00001": "two", "arxiv:2401.00002": None}
    assert lib.log().count() == 3 and lib.last_sync().first().n_records == 0
    assert {(r.store, r.key, r.change) for r in lib.sync_thin().where("store = 'arxiv'").collect()} == {("arxiv", "2401.00001", "added"), ("arxiv", "2401.00002", "added")}
    assert lib.sync_thin().count() == 0
    assert lib.build_entities() == {"entities": 2, "entity_collections": 2, "entity_rows": 2, "entity_status": 2}
    doi = rows(spark, {"ref_id": "doi:10.1000/b", "source": "crossref", "source_id": "10.1000/b", "doi": "10.1000/b"}).withColumns({"journal": F.lit("Some Journal"), "issn": F.lit("1-1")})
    missing = lib.add_dois(spark.createDataFrame([("10.1000/B",), ("10.1000/none",)], "d string"), lambda wanted: doi, auto_register=True)
    assert [r.doi for r in missing.collect()] == ["10.1000/none"] and lib.read("some_journal").count() == 1
    lib.enrich("2401.00002", "10.1000/B")
    with pytest.raises(ValueError, match="paired"):
        lib.add_pair("2401.00002", "10.1000/c")
    assert {r.scope: (r.n_missing, r.n_extra) for r in lib.audit_reference_cache().where("n_missing + n_extra > 0").collect()} == {"doi": (1, 0), "pairs": (1, 0)}
    lib.sync_thin()
    assert lib.audit_reference_cache().where("n_missing + n_extra > 0").count() == 0
    assert tuple(lib.audit_authoritative().first()) == (0, 0, 0)
    found = lib.audit_entities({"findings": spark.createDataFrame([("lost",)], "ref_id string")})
    assert [tuple(r) for r in found["orphans"].collect()] == [("findings", "lost")] and {r.health for r in found["health"].collect()} == {"ok"}
    with pytest.raises(ValueError, match="unknown collection"):
        lib.sync("x")


def test_label_index(spark, tmp_path):
    seen = []

    def embed(texts):
        seen.extend(texts)
        return np.array([[1.0, 0.0] if "one" in t else [0.0, 1.0] for t in texts])

    index = LabelIndex(spark, str(tmp_path / "i"), "m")
    assert index.build({"a": ["one"], "b": ["two", "more"]}, embed) == 3 and index.build({"a": ["one"], "b": ["other"]}, embed) == 1
    assert {r.query_id: r.query_text for r in index.read().collect()} == {"a__001": "one", "b__001": "other"}
    vecs = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "ref_id string, vec array<float>")
    got = {(r.ref_id, r.category_id): r.score_max for r in index.score(vecs, ("max",), 0, ref_ids=["x"]).collect()}
    assert got == {("x", "a"): 1.0, ("x", "b"): 0.0}
    for bad in ({"aggregations": ("median",)}, {"aggregations": ()}, {"top_k": -1}, {"date_from": "2024-01-01"}):
        with pytest.raises(ValueError):
            index.score(vecs, **bad)
    with pytest.raises(ValueError, match="model"):
        LabelIndex(spark, str(tmp_path / "i"), "other").read()
    with pytest.raises(ValueError, match="none of"):
        embeddings.migrated(vecs)


def test_digest_store(spark, tmp_path):
    made = digest.parse(spark.createDataFrame([(json.dumps(digest.template("a") | {"summary": "s"}),)], "json string"))
    store = digest.Store(spark, str(tmp_path))
    store.write(made)
    store.write(made.withColumn("summary", F.lit("again")))
    assert [(r.digest_revision, r.derived_from_revision) for r in store.history().orderBy("digest_revision").collect()] == [(1, None), (2, 1)]
    store.write(made.withColumn("schema_version", F.lit("v3")).withColumn("summary", F.lit("v3")))
    assert [(r.digest_revision, r.schema_version) for r in store.history().orderBy("digest_revision").collect()] == [(1, "v5"), (2, "v3")]
    store.write(made.withColumn("summary", F.lit("alone")), keep_history=False)
    assert store.history().count() == 1 and store.read(["a"], ["summary"]).first().summary == "alone"
    with pytest.raises(ValueError, match="digest"):
        store.write(made.withColumn("ref_id", F.lit(" ")))
    good = {"schema_version": "v5", "prompt_version": "p", "released_at": "2024-01-01"}
    assert digest.release(good) == good
    for bad in ({}, good | {"schema_version": "v9"}):
        with pytest.raises(ValueError):
            digest.release(bad)


def test_components(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(30)] + [("x", "y"), ("y", None), ("z", "z")], "a string, b string")
    got = {r.id: r.component for r in graph.components(links).collect()}
    assert {got[f"n{i:03}"] for i in range(31)} == {"n000"} and (got["x"], got["y"], got["z"]) == ("x", "x", "z")
