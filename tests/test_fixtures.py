"""Small literal inputs with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import checks, ids, text, vocab
from stemma.operators import digest, embeddings, graph, lexical, references, research, upsert
from stemma.sources import bibtex, config, providers, records, tables
from stemma.streaming import ingest


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "f, value, want",
    [
        (ids.arxiv_ref_id, " arXiv:2505.07087v3 ", "arxiv:2505.07087"),
        (ids.arxiv_ref_id, "hep-th/9901001", None),
        (ids.doi_ref_id, "https://doi.org/10.1016/J.X", "doi:10.1016/J.X"),
        (ids.bare_doi, "doi:10.1016/J.X", "10.1016/j.x"),
        (ids.bare_arxiv, "https://arxiv.org/abs/2401.00001v2", "2401.00001"),
        (ids.arxiv_version, "2401.00001v12", 12),
        (ids.arxiv_version, "2401.00001", 0),
        (ids.isbn_ref_id, "ISBN: 978-3-16-148410-0", "isbn:9783161484100"),
        (ids.isbn_ref_id, "12", None),
        (ids.route, " 2505.07087v3 ", "arxiv_id"),
        (ids.route, "https://doi.org/10.1016/a", "doi"),
        (ids.route, "978316", "isbn"),
        (ids.route, None, None),
        (ids.digest_key, " ArXiv:2401.1 ", "2401.1"),
        (ids.shard_year, "arxiv:9912.1234", "1999"),
        (ids.shard_year, "2401.00001v1", "2024"),
        (ids.shard_year, "x", "unknown"),
        (ids.expand_keys, "2401.00001v1", ["2401.00001v1", "2401.00001", "arxiv:2401.00001"]),
        (ids.lookup_candidates, "2501_12345", ["2501.12345", "arxiv:2501.12345"]),
        (text.normalize, "Retrieval-Augmented Generation (RAG) for LLMs", "retrieval augmented generation rag for llms"),
        (text.normalize, None, ""),
        (text.tokens, "GPT-4 with C++ and C# for RAG", ["gpt-4", "with", "c++", "and", "c#", "for", "rag"]),
        (lambda c: text.tokens(c, True), "GPT-4", ["gpt", "4"]),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


def test_slug(spark):
    assert one(spark, ids.record_slug, "10.1/A b", "x") == "10_1_a_b" and one(spark, ids.record_slug, None, None) == "record"


def corpus(spark):
    rows = [("d1", "retrieval augmented generation retrieval large language model"), ("d2", "retrieval method"), ("d3", "graph neural network"), ("d4", None)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_bm25(spark, tmp_path):
    query = "retrieval augmented generation large language model"
    got = lexical.search(corpus(spark), query).collect()
    assert [r.doc_id for r in got] == ["d1", "d2"]
    index = lexical.build_index(corpus(spark))
    index.write(str(tmp_path / "i"))
    again = lexical.search_index(lexical.Index.load(spark, str(tmp_path / "i")), query).collect()
    assert [(r.doc_id, pytest.approx(r.score)) for r in got] == [(r.doc_id, r.score) for r in again]
    only = spark.createDataFrame([("d2",)], "doc_id string")
    assert [r.doc_id for r in lexical.search(corpus(spark), query, restrict_ids=only).collect()] == ["d2"]
    assert lexical.search(corpus(spark), query, top_k=0).count() == 0 == lexical.search(corpus(spark), "absent").count()
    with pytest.raises(ValueError, match="no usable term"):
        lexical.search(corpus(spark), "()")
    with pytest.raises(ValueError, match="not unique"):
        lexical.build_index(corpus(spark).unionByName(corpus(spark)))
    pruned = lexical.build_index(corpus(spark), min_df=2)
    assert [r.term for r in pruned.vocab.collect()] == ["retrieval"] and pruned.postings.count() == 2 and pruned.docs.count() == 4


def test_labels(spark):
    rows = [("a1", "A RAG system: retrieval-augmented generation with an LLM"), ("a2", "graph neural networks"), ("a3", "finance with large language models and LLM risk")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    sets = {"ai_methods": {"rag": ["RAG", "retrieval augmented generation"], "llm": ["LLM", "llm", "large language models"]}, "": {"x": ["graph"]}, "finance_ai": {"fin": ["finance"]}}
    got = lexical.label(docs, sets)
    assert {r.doc_id for r in got["set_matches"].collect()} == {"a1", "a3"}
    assert {(r.doc_id, r.category, r.n_keywords) for r in got["category_scores"].collect()} == {("a1", "rag", 2), ("a1", "llm", 1), ("a3", "llm", 2), ("a3", "fin", 1)}
    assert lexical.flatten_query_sets({"s": {"c": ["b", "a", "b", " "]}}) == [("s", "c", "a"), ("s", "c", "b")]
    scores = lexical.phrase_scores(docs, {"x": ["retrieval generation", "with LLM"], "y": ["network"]}).collect()
    assert [(r.doc_id, r.category, r.score_max) for r in scores] == [("a1", "x", 2)]


def test_embeddings(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0]), ("d", None)], "ref_id string, vec array<float>")
    assert [r.ref_id for r in embeddings.search(index, [1.0, 0.0, 0.0], 3).collect()] == ["a", "b", "c"]
    assert embeddings.search(index, [1.0, 0.0, 0.0], 0).columns == ["ref_id", "score"]
    embeddings.assert_unit(index.where("vec is not null"))
    with pytest.raises(ValueError, match="unit length"):
        embeddings.assert_unit(spark.createDataFrame([("a", [2.0, 0.0])], "ref_id string, vec array<float>"))
    with pytest.raises(ValueError, match="dimensions"):
        embeddings.assert_unit(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0])], "ref_id string, vec array<float>"))
    queries = spark.createDataFrame([(c, q, [float(c == "x"), float(c == "y"), 0.0]) for c, q, *_ in embeddings.query_rows({"x": ["s", "t"], "y": ["u", " "]})], "category_id string, query_id string, vec array<float>")
    scores = embeddings.category_scores(index, queries)
    assert {(r.ref_id, r.category_id, r.query_n, r.score_max) for r in scores.collect()} == {(i, c, 2 if c == "x" else 1, float((i == "c") == (c == "y"))) for i in "abc" for c in "xy"}
    assert embeddings.pair_scores(index, queries).count() == 9
    assert {r.ref_id for r in embeddings.label(scores, {"x": 0.5, "y": 2.0}).collect()} == {"a", "b"}
    assert {r.ref_id: r.category_id for r in embeddings.best_category(scores).collect()} == {"a": "x", "b": "x", "c": "y"}


def test_embedding_life_cycle(spark):
    docs = spark.createDataFrame([(f"r{i}", f"text {i}" if i else " ") for i in range(10)], "ref_id string, abstract string")
    main = spark.createDataFrame([("r1", [1.0, 0.0])], "ref_id string, vec array<float>")
    todo = embeddings.targets(docs, [main])
    assert todo.count() == 8 and [r.ref_id for r in embeddings.targets(docs, [main], limit=2).collect()] == ["r2", "r3"]
    new = embeddings.embed(todo, lambda texts: np.array([[1.0, len(t)] for t in texts]), batch_size=3)
    assert new.count() == 8 and new.schema["vec"].dataType.simpleString() == "array<float>"
    with pytest.raises(Exception, match="embedding function"):
        embeddings.embed(todo, lambda texts: np.zeros((1, 2)), batch_size=3).collect()
    delta = new.drop("text").withColumn("seq", F.lit(1)).unionByName(spark.createDataFrame([("r1", [0.0, 1.0], 2)], "ref_id string, vec array<float>, seq int"))
    got = {r.ref_id: list(r.vec) for r in embeddings.compact(main, delta).collect()}
    assert len(got) == 9 and got["r1"] == [0.0, 1.0]
    s = embeddings.state(docs, main, delta).first()
    assert (s.total_records, s.unique_embedded, s.missing_records, s.coverage_pct, s.recommended_action) == (10, 9, 1, 0.9, "compact_delta")
    raw = docs.where("ref_id in ('r1', 'r2')")
    full = embeddings.repair_raw(raw, docs.where("ref_id <> 'r0'"))
    assert full.count() == 9 and embeddings.repair_raw(full, docs.where("ref_id <> 'r0'")).count() == 9
    with pytest.raises(ValueError):
        embeddings.repair_raw(raw, docs)


def test_merge_versions(spark):
    schema = "key string, title string, note string, version int, authors_list array<string>"
    old = spark.createDataFrame([("a", "old", "mine", 3, ["x"]), ("b", "t", None, 1, None), ("e", "only old", None, 1, None)], schema)
    new = spark.createDataFrame([("a", "older", "yours", 1, []), ("b", "T", "n", 2, ["y"]), ("c", "new", None, 1, None)], schema)
    merged, conflicts = upsert.merge(old, new, "key", "version")
    got = {r.key: (r.title, r.note, r.version, r.authors_list) for r in merged.collect()}
    assert got == {"a": ("old", "mine", 3, ["x"]), "b": ("T", "n", 2, ["y"]), "c": ("new", None, 1, None), "e": ("only old", None, 1, None)}
    assert {(r.key, r.field, r.old, r.new) for r in conflicts.collect()} == {("b", "title", "t", "T"), ("b", "version", "1", "2")}


def test_upserts(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, l string, v int")
    new = spark.createDataFrame([("a", "", 9), ("a", "", 8), ("c", "z", 3)], "k string, l string, v int")
    assert {(r.k, r.v) for r in upsert.upsert(old, new, ["k", "l"], "v").collect()} == {("a", 8), ("b", 2), ("c", 3)}
    pairs = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "arxiv_id string, doi string")
    in_ = spark.createDataFrame([("1", "y")], "arxiv_id string, doi string")
    assert {tuple(r) for r in upsert.upsert_pairs(pairs, in_, "arxiv_id", "doi").collect()} == {("1", "y"), ("3", "z")}
    table, changes = upsert.upsert_scaffold(pairs, in_, ["arxiv_id"], remove_missing=True)
    assert table.count() == 1 and {tuple(r) for r in changes.collect()} == {("2", "removed"), ("3", "removed")}
    with pytest.raises(ValueError, match="already paired"):
        references.add_pair(pairs, "9", "X")
    assert references.add_pair(pairs, "9", "q").count() == 4
    twice = pairs.unionByName(spark.createDataFrame([("1", "w")], pairs.schema))
    assert {(r.side, r.id, r.n) for r in references.ambiguous(twice, "arxiv_id", "doi").collect()} == {("arxiv_id", "1", 2)}


EDGES = "source_ref_id string, target_ref_id string, anchor_ref_id string, anchor_rank int, anchor_role string, relationship string"


def test_graph(spark):
    rows = [("1", "2", "2", 1, "theoretical_foundation", ""), ("1", "ext", "ext", 2, "", "compares_with"), ("2", "3", "3", 1, "", "extends"), ("3", "1", "1", 1, "", "other")]
    edges = spark.createDataFrame(rows, EDGES)
    cached = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    nodes, kept, meta = graph.build(edges, ["1"], cached)
    assert {(r.id, r.depth, r.node_type) for r in nodes.collect()} == {("1", 0, "cached"), ("2", 1, "cached"), ("ext", 1, "external"), ("3", 1, "cached")}
    assert kept.count() == 4 and meta["truncated_nodes"] == 0
    assert [r.edge_type for r in kept.orderBy("source_ref_id", "target_ref_id").collect()] == ["foundation", "comparison", "extension", "context"]
    small = graph.build(edges, ["1"], cached, max_nodes=2)
    assert small[0].count() == 2 and small[2]["truncated_nodes"] >= 1
    assert graph.build(edges, ["1"], cached, include=["foundation"])[0].count() == 2
    with pytest.raises(ValueError):
        graph.build(edges, ["1"], include=["context"], exclude=["context"])
    with pytest.raises(ValueError):
        graph.build(edges, ["1"], include=["no"])


def test_providers(spark):
    message = {
        "DOI": "10.1000/testdoi", "title": ["T"], "author": [{"given": "Jane", "family": "Doe"}, {"name": "John Smith"}], "published-print": {"date-parts": [[2020, 5]]},
        "issued": {"date-parts": [[1999]]}, "container-title": ["J"], "ISSN": ["1-1", "2-2", "1-1"], "ISBN": [], "link": [{"URL": "http://x/p.pdf"}],
    }
    r = providers.crossref_messages(spark.createDataFrame([(json.dumps(message),)], "json string")).first()
    assert (r.ref_id, r.authors, r.year, r.month, r.day, r.issn, r.isbn, r.url, r.url_pdf) == (
        "doi:10.1000/testdoi", "Jane Doe; John Smith", 2020, 5, 1, "1-1; 2-2", None, "https://doi.org/10.1000/testdoi", "http://x/p.pdf",
    )
    xml = (
        '<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="u"><id>http://arxiv.org/abs/2501.12345v2</id><title>T</title><summary>S</summary><published>2025-01-02T03:04:05Z</published>'
        '<author><name>A</name></author><author><name>B</name></author><arxiv:doi>10.1/x</arxiv:doi><category term="cs.AI"/><link href="http://h" rel="alternate"/></entry>'
    )
    r = providers.atom_entries(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.ref_id, r.arxiv_version, r.entry_type, r.authors, r.year, r.linked_doi_ref_id, r.url) == ("arxiv:2501.12345", 2, "unpublished", "A; B", 2025, "doi:10.1/x", "http://h")
    html = '<meta name="citation_title" content="Page"><meta content="A" name="citation_author"><meta name="citation_author" content="B"><meta name="citation_firstpage" content="1"><meta name="citation_lastpage" content="9">'
    page = providers.html_meta(spark.createDataFrame([("10.1/X", html, "http://u")], "doi string, html string, url string"))
    r = page.first()
    assert (r.title, r.authors, r.pages, r.url) == ("Page", "A; B", "1-9", "http://u")
    cite = providers.datacite(spark.createDataFrame([("10.1/x", json.dumps({"data": {"attributes": {"titles": [{"title": "DC"}], "publisher": "P", "publicationYear": 2001}}}))], "doi string, json string"))
    r = providers.merge_messages(page, cite).first()
    assert (r.title, r.publisher, r.source, r.pub_date.year) == ("Page", "P", "doi_org_html", 2001)


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(
        "@article{k1, title={A {B}}, eprint={2401.00001v2}}\n@comment{x}\n@book{k2,\n doi = {10.1000/ABC},\n title=\"T\"}\n@misc{k3, url={https://arxiv.org/abs/2402.00002}}\n@misc{k4, isbn={978-3-16-148410-0}}\n@misc{arxiv:2403.00003, note={n}}\n@misc{k6, note={n}}"
    )
    got = bibtex.read(spark, str(tmp_path / "a.bib")).orderBy("seq").collect()
    assert [r.ref_id for r in got] == ["arxiv:2401.00001", "doi:10.1000/ABC", "arxiv:2402.00002", "isbn:9783161484100", "arxiv:2403.00003", None]
    linked = spark.createDataFrame([("2409.00009", "10.1000/abc")], "arxiv_id string, doi string")
    assert bibtex.read(spark, str(tmp_path / "a.bib"), linked).orderBy("seq").collect()[1].ref_id == "arxiv:2409.00009"
    with pytest.raises(ValueError, match="doesn't end"):
        bibtex.split("@article{a, title={x}")
    rows = spark.createDataFrame([("doi:10.1/x", "article", "P & Q", "A; B", "J", 2020)], "ref_id string, entry_type string, title string, authors string, journal string, year int")
    missing = bibtex.write(rows, ["doi:10.1/x", "doi:none"], str(tmp_path / "out"))
    assert missing == ["doi:none"]
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.strip() == "@article{doi_10_1_x, title = {P \\& Q},\n  author = {A and B},\n  year = {2020},\n  journal = {J}\n}"


def test_records(spark, tmp_path):
    rows = spark.createDataFrame(
        [("arxiv:1", "arxiv", "1", 1, "t", None), ("arxiv:1", "arxiv", "1", 3, "t3", "x"), ("doi:d", "crossref", "d", None, "u", None)],
        "ref_id string, source string, source_id string, arxiv_version int, title string, note string",
    )
    records.write_json(rows, str(tmp_path / "json"))
    back = records.read_json(spark, str(tmp_path / "json"), multi_line=False)
    assert {(r.ref_id, r.title) for r in back.collect()} == {("arxiv:1", "t3"), ("doi:d", "u")}
    payload = json.loads(records.payloads(rows, {"collection_id": "c"}).first().payload)
    assert payload["journal_config"] == {"collection_id": "c"}
    filled = records.hydrate(rows.select("ref_id", F.lit("").alias("note")), rows.where("note = 'x'"), ["note", "title"])
    assert {(r.ref_id, r.note, r.title) for r in filled.collect()} == {("arxiv:1", "x", "t3"), ("doi:d", None, None)}
    made = records.manual(spark.createDataFrame([("T", "10.1/x", None), ("U", None, "http://u")], "title string, doi string, url string"))
    assert [r.ref_id for r in made.collect()] == ["doi:10.1/x", "url:http://u"]
    with pytest.raises(ValueError, match="identifier"):
        records.manual(spark.createDataFrame([("T",)], "title string"))
    with pytest.raises(ValueError, match="more than 1 rows"):
        references.guard(rows, 1)


@pytest.mark.parametrize("table", list(research.TABLES.values()), ids=list(research.TABLES))
def test_research_tables(spark, tmp_path, table):
    root = str(tmp_path)
    values = {"ref_id": "r1", "finding_id": "f1", "table_id": "t1", "variable": "v", "anchor_rank": 1, "node_id": "n1", "claim_sentence": "A claim"}
    row = {n: values.get(n) for n in table.schema.names}
    text_col = table.searched[0]
    row[text_col] = row[text_col] or "Needle"
    df = spark.createDataFrame([row], table.schema)
    table.write(df, root)
    table.write(df.withColumn("ref_id", F.lit("r2")), root)
    assert {r.ref_id for r in table.read(spark, root).collect()} == {"r1", "r2"} and table.read(spark, root, ["r1"]).count() == 1
    table.compact(spark, root)
    assert not tables.exists(spark, f"{root}/{table.name}/delta")
    table.write(df.withColumn(table.schema.names[-1], F.lit("changed")), root)
    got = {r.ref_id: r[table.schema.names[-1]] for r in table.read(spark, root).collect()}
    assert got["r1"] == "changed" and len(got) == 2
    assert table.find(table.read(spark, root), query=str(row[text_col]).lower()).count() == 2
    assert table.find(table.read(spark, root), ref_id="r2").count() == 1
    with pytest.raises(ValueError):
        table.validate(df.withColumn("ref_id", F.lit(" ")))
    assert table.template(spark).count() == 1


def test_node_merge_and_vocabularies(spark):
    rows = spark.createDataFrame([("r", "n", "c", "Improves", "a; b", "2", "1"), ("r", "n", "c", "improves", "b; c", "1", "2"), ("r", None, "d", "??", None, None, None)], "ref_id string, node_id string, sentence string, logic_type string, tags string, created_at string, updated_at string")
    got = {r.claim_sentence: r for r in research.NODES.normalize(rows).collect()}
    assert (got["c"].tags, got["c"].created_at, got["c"].updated_at, got["c"].logic_type) == ("a; b; c", "1", "2", "A_improves_B")
    assert got["d"].logic_type == "unknown" and got["d"].node_id.startswith("node_")
    assert one(spark, lambda c: vocab.normalize(c, vocab.PAPER_TYPES), " Field - Experiment ") == "empirical_experimental"
    assert len(vocab.PAPER_TYPES) == 28
    with pytest.raises(ValueError):
        vocab.require(spark.createDataFrame([("nope",)], "paper_type string"), "paper_type", vocab.PAPER_TYPES)


def test_digests(spark):
    docs = [digest.template("a", "v5") | {"summary": "About RAG", "paper_type": "ML"}, {"ref_id": "b", "summary": "old"}, digest.template("c", "v2") | {"digest_revision": 0}]
    d = digest.parse(spark.createDataFrame([(json.dumps(x),) for x in docs], "json string"))
    assert {r.ref_id: (r.schema_version, r.paper_type) for r in d.collect()} == {"a": ("v5", "computational"), "b": ("v1", "unknown"), "c": ("v2", "unknown")}
    assert {(r.ref_id, r.problem) for r in digest.problems(d).collect()} == {("c", "digest_revision is below 1")}
    assert [r.ref_id for r in digest.find(d, "rag").collect()] == ["a"]
    h = digest.append(d.where("ref_id = 'a'"), d.where("ref_id = 'a'").withColumn("summary", F.lit("again")))
    assert digest.latest(h).first().summary == "again" and [r.digest_revision for r in digest.revisions(h, "a").collect()] == [2, 1]
    assert {r.ref_id: r.schema_version for r in digest.upgrade(d).collect()} == {"a": "v5", "b": "v2", "c": "v2"}
    assert "research_data_data_sources" in digest.flatten(d).columns and digest.details(d).count() == 3
    r = spark.createDataFrame([("1,200", ""), ("many firms", "")], "a string, b string").select(digest.sample_size(F.col("a"), F.col("b")).alias("x")).collect()
    assert [(x.x.sample_size, x.x.sample_size_note) for x in r] == [(1200.0, None), (None, "many firms")]
    assert digest.prompt({"intro": "Hi {{ name }}", "create": "C"}, {"name": "{{x}}"}, "create", False) == "Hi {{x}}\n\nC"
    for mode, has in (("create", True), ("revise", False), ("other", False)):
        with pytest.raises(ValueError):
            digest.prompt({}, {}, mode, has)


def test_config(spark, tmp_path):
    at = config.init(str(tmp_path / "root"))
    with pytest.raises(FileExistsError):
        config.init(str(tmp_path / "root"))
    row = {"collection_id": "c", "collection_type": "t", "title": "1", "remote_channel": "r", "local_path": "p"}
    at.write_text(json.dumps({"journals": [{**row, "title": "0"}, row]}))
    loaded = config.load(at)
    assert [c["title"] for c in loaded["collections"]] == ["1"] and config.journals(spark, loaded).columns[0] == "journal_id"
    at.write_text(json.dumps({"collections": [{"collection_id": "c"}]}))
    with pytest.raises(ValueError, match="missing"):
        config.load(at)
    (tmp_path / "q.csv").write_text("category_id,lexical_keywords\nlm,language model|llm\n")
    assert config.query_set(tmp_path / "q.csv") == {"lm": ["language model", "llm"]}


def test_streams(spark, tmp_path):
    data, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([], "k string, seq long, v int").schema
    batches = [[("a", 1, 1), ("b", 2, 2)], [("a", 3, 30), ("b", 1, 9)], [("c", 4, 4)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(data)
        ingest.upsert_into(ingest.files(spark, data, schema), out, ["k"], "seq", log).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {("a", 30), ("b", 2), ("c", 4)}
    ledger = spark.createDataFrame([("2024-01-01", 5), ("2024-01-02", 0)], "day string, total int").withColumn("day", F.to_date("day"))
    assert [str(r.day) for r in ingest.pending_days(ledger, "2024-01-01", "2024-01-03").orderBy("day").collect()] == ["2024-01-02", "2024-01-03"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError, match="missing: z"):
        checks.require_columns(df, "x", "z")
    assert checks.align(df, spark.createDataFrame([], "y string, z double").schema).collect() == [("a", None)]
    fresh, stored = (spark.createDataFrame(r, "k string, n int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 1)]))
    assert {tuple(r) for r in references.compare_status(fresh, stored, "k").collect()} == {("a", "missing"), ("b", "stale"), ("c", "orphan")}
    assert [r.health for r in references.index_health([("a", None, False), ("b", 1, False), ("c", 30_000_000, True), ("d", 1, True)], spark).collect()] == ["missing", "damaged", "oversized", "ok"]


def test_atom_entries_are_parsed_once(spark):
    rows = [
        "<entry><id>http://arxiv.org/abs/2401.00001v3</id><title>a <b>c &amp; d</b> &lt; e</title><link href='http://x/pdf/1'/><link rel='alternate' href='g'/><category/><category term='t'/></entry>",
        "<entry><title type='html'>x<!-- c --><![CDATA[ < y]]></title><author><name>A &amp; B</name></author><author/><author><name>C</name></author></entry>",
        "<other><title>t</title></other>", None,
    ]
    out = providers.atom_entries(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, xml string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1 and "XPathListEvaluator(/entry/link" not in plan
    got = [(r.ref_id, r.title, r.authors, r.url_landing, r.url_pdf, r.subject_all) for r in out.collect()]
    assert got[0] == ("arxiv:2401.00001", "a c & d < e", "", "g", "http://x/pdf/1", "t")  # a link without rel doesn't move the others
    assert got[1][1:3] == ("x < y", "A & B; C") and got[2] == (None, None, "", None, None, "") and got[3] == (None,) * 6
    for bad in ("<entry><title>x</entry>", "<entry/><entry/>", "no xml"):
        with pytest.raises(Exception, match="(?i)malformed|not one entry"):
            providers.atom_entries(spark.createDataFrame([(bad,)], "xml string")).collect()


@pytest.mark.parametrize(
    "entry, want",
    [
        ("@article{k100001,\n  eprint = {2401.100001}\n}", "arxiv:2401.100001"),
        ("@article{k, arxivid = {arXiv:2401.1000001v2}}", "arxiv:2401.1000001"),
        ("@article{k, eprint = {2401.123}}", None),
        ("@article{k, url = {https://arxiv.org/abs/2401.100001}}", None),
    ],
)
def test_arxiv_fields_hold_long_numbers(spark, entry, want):
    assert one(spark, bibtex.ref_id, entry, "k") == want
