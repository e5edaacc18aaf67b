"""The command line over small tables."""

import json

import numpy as np

from stemma import cli
from stemma.operators import digest
from stemma.sources.label_index import LabelIndex


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_reports(spark, tmp_path, capsys):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([("d1", "language model with retrieval"), ("d2", "a language model"), ("d3", "graphs")], "doc_id string, text string").write.parquet(docs)
    (tmp_path / "q.json").write_text(json.dumps({"lm": ["language model", "retrieval"]}))
    (tmp_path / "log").write_text("d2, d9\n")
    cli.main(["bm25", "--docs", docs, "--query", "retrieval language"], spark)
    assert [r["doc_id"] for r in lines(capsys)] == ["d1", "d2"]
    cli.main(["keyword-report", "--docs", docs, "--queries", str(tmp_path / "q.json"), "--min-keywords", "1", "--skip", str(tmp_path / "log")], spark)
    assert [(r["doc_id"], r["rank"]) for r in lines(capsys)] == [("d1", 1)]
    cli.main(["bm25-report", "--docs", docs, "--queries", str(tmp_path / "q.json")], spark)
    assert [r["doc_id"] for r in lines(capsys)] == ["d1", "d2"]
    cli.main(["build-index", "--docs", docs, "--out", str(tmp_path / "index")], spark)
    assert spark.read.parquet(str(tmp_path / "index/docs")).count() == 3


def test_graph_and_fields(spark, tmp_path, capsys):
    edges = str(tmp_path / "edges")
    schema = "source_ref_id string, target_ref_id string, anchor_ref_id string, anchor_rank int, anchor_role string, relationship string"
    spark.createDataFrame([("a", "b", "b", 1, "", "extends")], schema).write.parquet(edges)
    cli.main(["graph", "--edges", edges, "--roots", "a"], spark)
    got = lines(capsys)
    assert {r["id"] for r in got if "id" in r} == {"a", "b"} and got[-1]["nodes"] == 2
    digests = str(tmp_path / "digests")
    spark.createDataFrame([("a", "s", "m")], "ref_id string, summary string, motivation string").write.parquet(digests)
    cli.main(["digest-fields", "--digests", digests, "--fields", "summary", "--ids", "a", "z"], spark)
    assert lines(capsys) == [{"ref_id": "a", "summary": "s"}]


def test_library_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "library")
    (tmp_path / "feed.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>T</title></entry></feed>")
    (tmp_path / "works").write_text(json.dumps({"DOI": "10.1000/a", "title": ["A"]}) + "\n")
    cli.main(["add-records", "--library", root, "--payloads", str(tmp_path / "feed.xml"), "--kind", "atom", "--collection", "c"], spark)
    cli.main(["add-records", "--library", root, "--payloads", str(tmp_path / "works"), "--kind", "crossref", "--collection", "c"], spark)
    assert [r["ref_id"] for r in lines(capsys)] == ["arxiv:2401.00001", "doi:10.1000/a"]
    cli.main(["add-pair", "--library", root, "--arxiv", "2401.00001", "--doi", "10.1000/A"], spark)
    cli.main(["sync-thin", "--library", root], spark)
    assert {(r["store"], r["change"]) for r in lines(capsys)} == {("arxiv", "added"), ("doi", "added"), ("pairs", "added"), ("collections", "added")}
    cli.main(["build-entities", "--library", root], spark)
    assert lines(capsys)[0]["entities"] == 2
    cli.main(["audit", "--library", root], spark)
    got = lines(capsys)
    assert all(r["n_missing"] + r["n_extra"] == 0 for r in got if "scope" in r) and {r["health"] for r in got if "health" in r} == {"ok"}
    cli.main(["ref-summary", "--library", root, "--ids", "doi:10.1000/a"], spark)
    assert [r["title"] for r in lines(capsys)] == ["A"]


def test_digest_and_edge_commands(spark, tmp_path, capsys):
    store, out, log = (str(tmp_path / n) for n in ("digests", "edges", "log"))
    anchor = {"anchor_rank": 1, "anchor_ref_id": "doi:10.1/b", "anchor_role": "foundation"}
    (tmp_path / "d.json").write_text(json.dumps(digest.template("ref:a") | {"summary": "S", "anchor_references": [anchor]}))
    cli.main(["ingest-digests", "--json", str(tmp_path / "d.json"), "--store", store], spark)
    cli.main(["sync-anchor-edges", "--store", store, "--out", out], spark)
    assert [(r.source_ref_id, r.target_ref_id) for r in spark.read.parquet(out).collect()] == [("ref:a", "doi:10.1/b")]
    cli.main(["add-edge", "--log", log, "--source", "a", "--target", "b", "--relationship", "extends"], spark)
    assert spark.read.option("sep", "\t").option("header", True).csv(log).first().relationship == "extends"
    (tmp_path / "f.json").write_text(json.dumps({"intro": "Hi {{ name }}"}))
    (tmp_path / "v.json").write_text(json.dumps({"name": "you"}))
    cli.main(["digest-prompt", "--fragments", str(tmp_path / "f.json"), "--values", str(tmp_path / "v.json"), "--mode", "revise", "--store", store, "--ids", "ref:a"], spark)
    assert capsys.readouterr().out.strip() == "Hi you"
    bib, records_, pairs = (str(tmp_path / n) for n in ("x.bib", "records", "pairs"))
    (tmp_path / "x.bib").write_text("@misc{a, eprint={2401.00001}}\n@misc{b, title={B}}")
    spark.createDataFrame([("doi:10.1000/a", "article", "T")], "ref_id string, entry_type string, title string").write.parquet(records_)
    spark.createDataFrame([("2401.00001", "10.1000/a")], "arxiv_id string, doi string").write.parquet(pairs)
    cli.main(["replace-bibtex", "--path", bib, "--records", records_, "--pairs", pairs, "--out", str(tmp_path / "out")], spark)
    assert lines(capsys) == [{"key": "a", "outcome": "converted"}]
    vecs, labels = str(tmp_path / "vecs"), str(tmp_path / "labels")
    spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "ref_id string, vec array<float>").write.parquet(vecs)
    LabelIndex(spark, labels).build({"c": ["t"]}, lambda texts: np.array([[1.0, 0.0]] * len(texts)))
    cli.main(["embedding-report", "--index", vecs, "--labels", labels, "--top-n", "1"], spark)
    assert [(r["ref_id"], r["rank"]) for r in lines(capsys)] == [("x", 1)]
