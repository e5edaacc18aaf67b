"""Thin stores, the embedding store, and what joins them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import checks
from stemma.operators import graph, references, stores, upsert
from stemma.sources import bibtex, records, tables
from stemma.streaming import ingest
from stemma.sources.embedding_store import EmbeddingStore, import_matrix, read_float32_matrix, write_float32_matrix


def rows(spark, *given):
    names = "ref_id source source_id arxiv_version doi isbn collection_id title".split()
    df = spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], "ref_id string, source string, source_id string, arxiv_version int, doi string, isbn string, collection_id string, title string")
    return checks.align(df, records.SCHEMA)


def test_thin_stores(spark):
    a = {"ref_id": "arxiv:2401.00001", "source": "arxiv", "source_id": "2401.00001"}
    df = rows(spark, a | {"arxiv_version": 1, "doi": "10.1000/old", "collection_id": "c1"}, a | {"arxiv_version": 3, "doi": "10.1000/New", "collection_id": "c2"}, {"ref_id": "doi:10.1000/d", "source": "crossref", "doi": "10.1000/D"}, {"ref_id": "isbn:1", "isbn": "978-3-16-148410-0"})
    t = stores.thin(df)
    r = t.arxiv.first()
    assert (r.arxiv_id, r.arxiv_version, r.doi) == ("2401.00001", 3, "10.1000/new") and t.collections.count() == 2
    assert [x.doi for x in t.doi.collect()] == ["10.1000/d"] and t.isbn.count() == 1
    keys = spark.createDataFrame([("arXiv:2401.00001v2",), ("https://doi.org/10.1000/d",), ("nothing",)], "k string")
    assert {x.key: x.json_filename is not None for x in stores.locations(keys, t).collect()} == {"arXiv:2401.00001v2": True, "https://doi.org/10.1000/d": True, "nothing": False}
    both = rows(spark, a, {"ref_id": "doi:10.1000/new"}, {"ref_id": "doi:10.1000/x"})
    assert {x.ref_id for x in stores.published_form(both, t.pairs).collect()} == {"doi:10.1000/new", "doi:10.1000/x"}
    assert {x.ref_id: x.task_ref_id for x in stores.task_ref(both, t.pairs, "citation").collect()}["arxiv:2401.00001"] == "doi:10.1000/new"
    with pytest.raises(ValueError, match="ambiguous"):
        stores.thin(df, spark.createDataFrame([("2401.00001", "10.1000/other")], "arxiv_id string, doi string"))
    with pytest.raises(ValueError, match="not unique"):
        stores.thin(rows(spark, {"ref_id": "doi:10.1000/a", "doi": "10.1000/d"}, {"ref_id": "x", "source_id": "y", "doi": "10.1000/D ", "title": "t"}).withColumn("doi", F.col("doi")).unionByName(rows(spark, {"ref_id": "q", "doi": "doi:10.1000/D"})))


def test_adding_records(spark, tmp_path):
    at, log = str(tmp_path / "r"), str(tmp_path / "log")
    a = {"source": "arxiv", "source_id": "2401.00001v1", "ref_id": "arxiv:2401.00001v1"}
    stores.add(spark, at, rows(spark, a | {"arxiv_version": 1, "title": "one"}))
    stores.add(spark, at, rows(spark, a | {"arxiv_version": 2, "title": "two"}), log)
    stores.add(spark, at, rows(spark, a | {"arxiv_version": 1, "title": "late"}))
    stores.add_manual(spark, at, spark.createDataFrame([("10.1000/m", "M")], "doi string, title string"), "mine")
    got = {r.ref_id: r.title for r in spark.read.parquet(at).collect()}
    assert got == {"arxiv:2401.00001": "two", "doi:10.1000/m": "M"}
    assert "title" in {r.field for r in spark.read.json(log).collect()}
    message = json.dumps({"DOI": "10.1000/j", "title": ["T"], "container-title": ["Journal of X"], "ISSN": ["1-1"]})
    known = spark.createDataFrame([("jx", "journal of x", [], 1)], "collection_id string, title string, issns array<string>, seq int")
    df = spark.createDataFrame([(message,)], "json string")
    assert stores.add_messages(spark, at, df, known).first().collection_id == "jx" and spark.read.parquet(at).count() == 3
    free = rows(spark, {"ref_id": "doi:1"}, {"ref_id": "doi:2"}).withColumn("journal", F.when(F.col("ref_id") == "doi:1", "New Journal").otherwise("12")).withColumn("issn", F.lit("2-2; 3-3"))
    assert [tuple(r) for r in stores.new_journals(free, known).collect()] == [("new_journal", "New Journal", ["2-2", "3-3"])]


def test_research_status(spark):
    refs = spark.createDataFrame([("a",), ("b",)], "ref_id string")
    d = spark.createDataFrame([("a", "v5", 2, "t")], "ref_id string, schema_version string, digest_revision int, updated_at string")
    s = stores.research_status(refs, d, {"findings": spark.createDataFrame([("b",), ("b",)], "ref_id string")})
    assert {r.ref_id: (r.has_llm_digest, r.revision, r.n_findings, r.has_findings) for r in s.collect()} == {"a": (True, 2, 0, False), "b": (False, None, 2, True)}


def test_embedding_store(spark, tmp_path):
    def embed(texts):
        return np.array([[1.0, 0.0] if "one" in t else [0.0, 1.0] for t in texts])

    docs = spark.createDataFrame([("arxiv:2301.00001", "one"), ("arxiv:2401.00002", "two"), ("x", " ")], "ref_id string, abstract string")
    store = EmbeddingStore(spark, str(tmp_path / "e"), "c", model="m")
    store.build(docs, embed)
    assert store.manifest().first().records == 2 and store.delta().count() == 0
    assert [r.ref_id for r in store.search("one", embed, 1).collect()] == ["arxiv:2301.00001"]
    assert [r.ref_id for r in store.search([1.0, 0.0], years=["2024"]).collect()] == ["arxiv:2401.00002"]
    more = docs.unionByName(spark.createDataFrame([("arxiv:2301.00009", "one more")], docs.schema))
    store.append(more, embed)
    assert store.delta().count() == 1 and store.diagnose(more).first().recommended_action == "compact_delta"
    store.compact()
    assert store.main().count() == 3 and store.diagnose(more).first().missing_records == 1
    with pytest.raises(ValueError, match="model"):
        EmbeddingStore(spark, str(tmp_path / "e"), "c", model="other").search([1.0, 0.0])
    store.reset(preserve_delta=False)
    assert store.main().count() == 0


def test_repeated_ids_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return np.ones((len(texts), 2)) / np.sqrt(2)

    docs = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three")], "ref_id string, abstract string")
    store = EmbeddingStore(spark, str(tmp_path / "e"), "c")
    store.append(docs, embed)
    assert {(r.ref_id, r.abstract) for r in store.delta().collect()} == {("a", "one"), ("b", "three")} and calls.value == 2


def test_batches_appended_while_compacting_stay(spark, tmp_path, monkeypatch):
    one = lambda texts: np.array([[1.0, 0.0]] * len(texts))
    row = lambda i: spark.createDataFrame([(f"arxiv:2301.0000{i}", "t")], "ref_id string, abstract string")
    store = EmbeddingStore(spark, str(tmp_path / "e"), "c")
    store.append(row(1), one)
    folded = store.batches()
    monkeypatch.setattr(store, "batches", lambda: folded)
    EmbeddingStore(spark, str(tmp_path / "e"), "c").append(row(2), one)
    store.compact()
    fresh = EmbeddingStore(spark, str(tmp_path / "e"), "c")
    assert [r.ref_id for r in fresh.delta().collect()] == ["arxiv:2301.00002"] and [r.ref_id for r in fresh.main().collect()] == ["arxiv:2301.00001"]
    fresh.compact()
    assert fresh.main().count() == 2 and not fresh.batches()


def test_overwrite_survives_a_crash_between_its_steps(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.overwrite(spark.range(3), at)
    (tmp_path / "t").rename(tmp_path / "t.previous")  # the old table is aside, the new one isn't there yet
    assert tables.load(spark, at).count() == 3
    tables.overwrite(tables.load(spark, at).where("id > 0"), at)
    assert tables.load(spark, at).count() == 2 and not (tmp_path / "t.previous").exists()
    (tmp_path / "t").rename(tmp_path / "t.previous")
    tables.overwrite(spark.range(5), at)
    assert tables.load(spark, at).count() == 5


def test_keys_of_records_with_null_ids(spark):
    records_ = spark.createDataFrame([(None, None, "10.1/a"), (None, None, "10.1/b"), ("10.1/b", "s", "10.1/b"), ("x", "s", None)], "ref_id string, source_id string, doi string")
    keys = spark.createDataFrame([("10.1/a",), ("10.1/b",), ("s",)], "k string")
    got = sorted((r.doi or "", r.ref_id or "", r.matched_by) for r in references.by_keys(records_, keys).collect())
    assert got == [("", "x", "source_id"), ("10.1/a", "", "doi"), ("10.1/b", "", "doi"), ("10.1/b", "10.1/b", "doi")]


def test_repeated_incoming_keys_need_an_order(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 1)], "k int, v string, n int")
    with pytest.raises(ValueError, match="not unique"):
        upsert.upsert(old, new, ["k"])
    assert {(r.k, r.v) for r in upsert.upsert(old, new, ["k"], "n").collect()} == {(1, "c"), (2, "d")}
    table, changes = upsert.upsert_scaffold(old, new.where("n = 1"), ["k", "v"])
    assert table.count() == 3 and {(r.k, r.change) for r in changes.collect()} == {("1\tc", "added"), ("2\td", "added")}


def test_closed_windows_are_appended_and_late_rows_dropped(spark, tmp_path):
    data, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([], "ts timestamp, k string").schema
    for day, n in (("2024-01-01", 2), ("2024-01-03", 1), ("2024-01-01", 4), ("2024-01-06", 1)):
        spark.createDataFrame([(day, "a")] * n, "d string, k string").select(F.to_timestamp("d").alias("ts"), "k").coalesce(1).write.mode("append").parquet(data)
        stream = ingest.windowed_counts(ingest.files(spark, data, schema), "ts")
        ingest.append_to_table(stream, out, log).awaitTermination()
    got = {(str(r.window.start)[:10], r.n) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01", 2), ("2024-01-03", 1)}


def test_raw_matrix(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "m.f32").write_bytes(write_float32_matrix(m))
    assert (read_float32_matrix((tmp_path / "m.f32").read_bytes(), 4, 3) == m).all()
    with pytest.raises(ValueError):
        read_float32_matrix(b"1234", 2, 2)
    names = spark.createDataFrame([(f"r{i}", i) for i in range(4)], "ref_id string, seq int")
    assert {r.ref_id: list(r.vec) for r in import_matrix(spark, str(tmp_path / "m.f32"), names, 3).collect()} == {f"r{i}": m[i].tolist() for i in range(4)}


def test_linked_doi_entries(spark):
    e = [(0, "a", "@misc{a, eprint={2401.00001}}"), (1, "b", "@misc{b, eprint={2401.00002}}"), (2, "c", "@misc{c, eprint={2401.00003}, doi={10.1000/zz}}"), (3, "d", "@misc{d, doi={10.1000/q}}")]
    df = spark.createDataFrame(e, "seq int, key string, entry string")
    pairs = spark.createDataFrame([("2401.00001", "10.1000/A"), ("2401.00002", "10.1000/b"), ("2401.00003", "10.1000/c")], "arxiv_id string, doi string")
    have = spark.createDataFrame([("doi:10.1000/a", "article", "T")], "ref_id string, entry_type string, title string")
    got = {r.key: r for r in bibtex.prefer_linked_doi(df, pairs, have).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "converted", "b": "missing", "c": "suspicious", "d": "kept"}
    assert got["a"].entry.startswith("@article{") and got["b"].entry == e[1][2]


def test_described_nodes(spark):
    nodes = spark.createDataFrame([("a", 0), ("x", 1)], "id string, depth int")
    edges = spark.createDataFrame([("a", "x", 1, "Anchor")], "source_ref_id string, target_ref_id string, anchor_rank int, anchor_title string")
    titles = spark.createDataFrame([("a", "Title")], "ref_id string, title string")
    assert {r.id: r.title for r in graph.described(nodes, titles, edges).collect()} == {"a": "Title", "x": "Anchor"}
