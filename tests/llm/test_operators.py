"""Each operator against a brute-force version, and on awkward rows."""

import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stemma.llm import (
    codepoints, common, embedding_dedup, graph, html_extraction, language_id, mixing, packing, quality_classifier, quality_rules, simhash, tokens, url_filters,
)
from stemma.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words string, kept string, fp string, h string, component string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    long = " ".join(rnd.choice(vocabulary) for _ in range(30_000))
    base = " ".join(rnd.choice(vocabulary) for _ in range(120))
    near = base.replace(base.split()[60], "other", 1)
    texts = [
        None, "", "   \n\t ", "one", "A b C", base, base, near, base.upper(), long, "same same same " * 40, "x#y $ | <> & %* " * 30,
        "line one here\nline one here\n\nline two\n" * 20, "日本語 テキスト です " * 20, "naïve café Straße\x85 \xa0mixed " * 15, "\x0b\x0cform feed\r\n words " * 20,
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None), (None, None, "en", "s1")]
    return [(*r, None, 7, "x", "y", "z", "h", "c", "s") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if not isinstance(x, list) else str(x)) for x in r])


def test_registered():
    assert [f"op{n}_" for n in range(1, 11)] == sorted((re.match(r"op\d+_", q)[0] for q in QUERIES), key=lambda s: int(s[2:-1]))
    assert {"op1_quality_rules", "op3_embedding_dedup", "op5_url_filters", "op7_mixing"} == set(ORACLE_SQL)


# 1 quality rules


def brute_stats(text):
    text = text or ""
    w = words(text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p + o for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    got = quality_rules.apply(docs).select("doc_id", "text", "__qr_stats", "__qr_kept").collect()
    assert len(got) == docs.count()
    for r in got:
        s = r["__qr_stats"]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_stats(r.text), r.doc_id
        if s.n_words < 50 or 2 * s.n_repeat_words > s.n_words:
            assert not r["__qr_kept"]


def test_quality_thresholds_follow_the_group(spark):
    noise = "#w " * 3
    rows = [(i, " ".join(f"{'w' * (k % 6 + 1)}{i}x{k}" for k in range(80)) + (" " + noise * 10 if s == "b" else ""), "en", s) for i in range(60) for s in ("a", "b")]
    rows.append((1000, " ".join(f"q{k}#" for k in range(100)), "en", "a"))
    out = quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {(r.doc_id, r.source): r["__qr_kept"] for r in out.collect()}
    assert kept[1000, "a"] is False
    assert all(v for k, v in kept.items() if k[0] != 1000)  # what every document of b has is no fault there


def test_quality_group_full_of_copies(spark):
    """Copies leave their group no spread; its language's keeps the other documents."""
    rnd = random.Random(9)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) + rnd.choice(["", "", "", ","]) for _ in range(90))
    rows = [(i, text(), "en", "other") for i in range(200)] + [(1000 + i, text(), "en", "hot") for i in range(40)]
    rows += [(2000 + i, rows[0][1], "en", "hot") for i in range(160)]
    rows += [(3000, " ".join(f"{'q' * (k % 7 + 1)}#{k}#" for k in range(90)), "en", "hot")]
    out = quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert [r.doc_id for r in out.where("not __qr_kept").collect()] == [3000]


def test_quality_no_spread_no_threshold(spark):
    rows = [(i, " ".join(f"w{k:02d}{i:02d}" for k in range(60)), "en", "s") for i in range(40)]
    rows.append((99, " ".join(f"w{k:02d}#" for k in range(60)), "en", "s"))
    out = quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert out.where("not __qr_kept").count() == 0


def test_quality_fences_decide(spark, sf):
    """No cutoff is fixed: of documents that the base rules keep, the fences find the bad and spare the good."""
    out = QUERIES["op1_quality_rules"](spark, sf).where("not base_failed").join(common.table(spark, sf, "labels"), "doc_id")
    got = {r[0]: (r[1], r[2]) for r in out.groupBy("quality").agg({"kept": "count", "base_failed": "count"}).collect()}
    lost = {r[0]: r[1] for r in out.where("not kept").groupBy("quality").count().collect()}
    assert lost.get(1, 0) <= 0.005 * got[1][0]
    assert lost[0] >= 0.9 * got[0][0]


def test_quality_empty(none):
    assert quality_rules.apply(none).count() == 0


# 2 languages


def test_language(spark, docs, none):
    rnd = random.Random(1)
    syllables = {"aa": ["tion", "the", "ing", "and"], "bb": ["sch", "der", "ung", "ein"], "cc": ["eau", "que", "les", "oui"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(40)), lang) for i in range(300) for lang in [rnd.choice("abc") * 2]]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(known)
    out = language_id.predictions(known, model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)
    assert model.predict([None, "", "123 !!"])[0] == ["und"] * 3
    assert model.predict(["thetion"])[0] == ["aa"]
    got = language_id.predictions(docs.drop("score"), model, ["doc_id"])
    assert got.count() == docs.count()
    assert language_id.learn(none).languages == [] and language_id.apply(none).count() == 0
    assert language_id.apply(docs).columns == docs.columns


def test_more_languages_than_bits_in_a_word(spark):
    rnd = random.Random(2)
    own = {f"l{i:03}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for i in range(140)}
    rows = [(i, " ".join(rnd.choice(own[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(own) * 6)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(known)
    assert sorted(model.languages) == sorted(own)
    names, _, share = model.predict([r[1] for r in rows])
    assert names == [r[2] for r in rows] and share.min() > language_id.KNOWN


def plain_grams(text):
    """Runs of four of a lower-cased text whose inner two are letters, others than letters as blanks."""
    c = "".join(x if x.isalpha() else " " for x in f" {text.lower()}\n")
    return [c[i : i + 4] for i in range(len(c) - 3) if c[i + 1 : i + 3].isalpha()]


def plain_hash(gram):
    """The hash of a run, in whole numbers."""
    mask = (1 << 64) - 1
    h = ord(gram[0])
    for x in gram[1:]:
        h = (h * 0x100000001B3 + ord(x) * 0x9E3779B1) & mask
    return h ^ h >> 29


TEXTS = ["The tion ing and", "Straße. ÉTÉ ΣΑΣ ab İx", "", "a b c d", "x1y2 zz-top 日本語テキスト", "abc" * 40 + " " + "de fg " * 30, None]


def test_grams_by_brute_force(monkeypatch):
    for piece in (codepoints.PIECE, 50, 7):
        monkeypatch.setattr(codepoints, "PIECE", piece)
        got, letters = {i: Counter() for i in range(len(TEXTS))}, Counter()
        for at, h, part, n in language_id.runs(TEXTS):
            for x, p in zip(h.tolist(), part.tolist(), strict=True):
                got[at[p]][x] += 1
            letters.update(dict(zip(at, n.tolist(), strict=True)) if len(set(at)) == len(at) else {at[0]: int(n.sum())})
        for i, t in enumerate(TEXTS):
            assert got[i] == Counter(map(plain_hash, plain_grams(t or ""))), (piece, t)
            assert letters[i] == sum(c.isalpha() for c in (t or "").lower())


def test_language_counts_by_brute_force(monkeypatch):
    """Bit-sliced filters against sets: no hit is missed, and counts are those of a plain Bloom filter, corrected."""
    profiles = [{"the ", " the", "tion", " and"}, {"sch ", " der", "tion", "traß"}, set()]
    model = language_id.Model.build(list("abc"), [np.array(sorted(map(plain_hash, p)), np.uint64) for p in profiles])
    spots = lambda g: [(plain_hash(g) * m & (1 << 64) - 1) >> 64 - model.bits for m in language_id._MIX]
    filled = [{s for g in p for s in spots(g)} for p in profiles]
    for piece in (codepoints.PIECE, 9):
        monkeypatch.setattr(codepoints, "PIECE", piece)
        counts, n, _ = model.counts(TEXTS)
        for i, t in enumerate(TEXTS):
            own = plain_grams(t or "")
            assert n[i] == len(own)
            for k, cells in enumerate(filled):
                hits = sum(all(s in cells for s in spots(g)) for g in own)
                assert hits >= sum(g in profiles[k] for g in own)
                rate = (len(cells) / (1 << model.bits)) ** language_id.HASHES
                assert counts[i, k] == pytest.approx(max(0, (hits - len(own) * rate) / (1 - rate)))


def test_language_profiles_by_brute_force(spark):
    rnd = random.Random(3)
    text = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))) for _ in range(30))
    rows = [(i, text("abcd" if i % 2 else "cdef"), "xy"[i % 2]) for i in range(90)]
    own = {lang: Counter(g for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1 for g in plain_grams(t)) for lang in "xy"}
    total = {lang: c.total() for lang, c in own.items()}
    want = {
        lang: {plain_hash(g) for g, n in c.items() if n >= language_id.LEAST and n / total[lang] >= language_id.SHARE * max(own[k][g] / total[k] for k in "xy")}
        for lang, c in own.items()
    }
    got = language_id.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang: set(p.tolist()) for lang, p in got.items()} == want


def test_language_sample_of_null_and_repeated_ids_is_bounded(spark):
    """Rows without an id, and rows that repeat, don't all get into the sample."""
    rows = [(None if i % 2 else 5, f"word{i} and {i}", "a") for i in range(30_000)] + [(5, "the same text", "a")] * 30_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    chosen, _ = language_id.sampled(df, 300)
    n = chosen.count()
    assert 50 < n < 600 and chosen.where("text = 'the same text'").count() <= 1


def test_false_positives_are_corrected():
    r = np.random.default_rng(0)
    profile = r.integers(0, 2**63, 3000, dtype=np.uint64)
    m = language_id.Model.build(["x"], [profile])
    for k in range(language_id.HASHES):
        assert (m.cells[m.places(profile, k, m.bits)] & 1).all()  # nothing that was put in is missed
    assert 0 < m.false_rate[0] < 0.05


# 3 embeddings


def brute_links(vecs):
    n = len(vecs)
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    adj = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                    adj[i].append(j)
    return adj


def closure(adj, ids):
    comp = {}
    for i in range(len(adj)):
        seen, todo = {i}, [i]
        while todo:
            for j in adj[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(ids[j] for j in seen)
    return comp


def test_embeddings(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    vecs = [(centres[i % 12] + r.normal(size=16) * 0.25 * (i % 5)).astype(np.float32).tolist() for i in range(700)]
    vecs += [vecs[0]] * 40 + [(np.array(vecs[0]) * 3).tolist()] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(10, 10 + len(vecs)))
    df = spark.createDataFrame(list(zip(ids, vecs, ids, ids, strict=True)), "vec_id long, embedding array<float>, label long, n_links long").repartition(5)
    got = {x.vec_id: x for x in embedding_dedup.apply(df).collect()}
    vecs = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vecs]
    adj = brute_links(vecs)
    comp = closure(adj, ids)
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(adj[k]), comp[k], comp[k] == i)
    assert embedding_dedup.apply(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup.apply(lone).collect()} == {(None, 0, None, False), (4, 0, 4, True)}


def test_embeddings_in_parts(spark, monkeypatch):
    """Intervals that are too long for a task come in parts, and lose no link."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "MOST", 3)
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    r = np.random.default_rng(5)
    centres = r.normal(size=(25, 12))
    vecs = (centres[r.integers(0, 25, 500)] + r.normal(size=(500, 12)) * 0.35).tolist()
    got = {x.vec_id: x for x in embedding_dedup.apply(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect()}
    adj = brute_links(vecs)
    comp = closure(adj, list(range(500)))
    assert sum(map(len, adj)) > 500
    assert all((got[i].n_links, got[i].component_id) == (len(adj[i]), comp[i]) for i in range(500))


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-310])
def test_embeddings_of_any_size(spark, size):
    rows = [(1, [size, 2 * size]), (2, [1.0, 2.01]), (3, [-size, size]), (4, [-2.0, 2.1])]
    got = embedding_dedup.apply(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def test_grid_order_skips_and_loses_nothing():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(40, 8)) * 0.05 + c for c in np.eye(8) * 3])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = unit[embedding_dedup.sort(embedding_dedup.order_keys(unit))]
    boxes = embedding_dedup.Boxes(p, p)
    pairs = list(embedding_dedup.joined(boxes, boxes, 20, True))
    assert len(pairs) < 16 * 17 // 2
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for i, j in np.argwhere(np.triu(d <= embedding_dedup.EPS, 1)):
        assert any(a[0] <= i < a[1] and b[0] <= j < b[1] for a, b in pairs)


# 4 SimHash


def brute_fp(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, none):
    got = simhash.apply(docs).collect()
    rows = docs.collect()
    fps = {(r.doc_id, r.text): brute_fp(r.text) for r in rows}
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for (i, t), f in [((r.doc_id, r.text), fps[r.doc_id, r.text]) for r in rows])
    named = [(r.doc_id, fps[r.doc_id, r.text]) for r in rows if r.doc_id is not None]
    adj = [[j for j in range(len(named)) if (a ^ named[j][1]).bit_count() <= 4] for _, a in named]
    comp = closure(adj, [i for i, _ in named])
    want = {named[k][0]: c for k, c in comp.items()}
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert simhash.apply(none).count() == 0
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


@pytest.mark.parametrize("refine", [40, 10_000])
def test_simhash_large_buckets(spark, monkeypatch, refine):
    """Buckets over the block size, indexed anew or not, lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "REFINE", refine)
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = [base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(400)] + [r.getrandbits(64) for _ in range(300)] + [base] * 50
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = common.materialize(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), "fps")
    got = {x.fp: x.component for x in simhash.classes(df).collect()}
    adj = [[j for j in range(len(fps)) if (a ^ fps[j]).bit_count() <= 4] for a in fps]
    comp = closure(adj, list(range(len(fps))))
    assert all(got[signed[k]] == comp[k] for k in comp)


def test_simhash_runs_of_shingles(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "RUN", 37)
    assert simhash.fingerprint(text) == whole == brute_fp(text)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randint(0, 80), 100 + r.randint(0, 80)) for _ in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {n: k for k, n in enumerate(nodes)}
    adj = [[] for _ in nodes]
    for a, b in edges:
        if a != b:
            adj[at[a]].append(at[b])
            adj[at[b]].append(at[a])
    assert got == {nodes[k]: c for k, c in closure(adj, nodes).items()}


# 5 URLs


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme/casino", "", "", None, "block"),
        ("http://A.Example.COM/en/71?x#y", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://a.example.com/en/61", "a.example.com", "/en/61", "com/en/", "block"),
        ("http://x.example.net/de/85", "x.example.net", "/de/85", "example.net/de/8", "block"),
        ("http://badexample.com/en", "badexample.com", "/en", None, "allow"),
        ("http://net/de/1", "net", "/de/1", "net/de/", "block"),
        ("https://www.cheap-pills.example.com/fr/1", "www.cheap-pills.example.com", "/fr/1", None, "block"),
        ("https://free-bets.example.com/fr/1", "free-bets.example.com", "/fr/1", None, "block"),
        ("https://sussex.example.com/essex", "sussex.example.com", "/essex", None, "allow"),
        ("https://free.example.com/free", "free.example.com", "/free", None, "allow"),
        ("https://free.example.com/win", "free.example.com", "/win", None, "block"),
        ("ftp://?q", "", "", None, "allow"),
        ("http://h#f", "h", "", None, "allow"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filters.apply(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://example.com/en/70/casino", "example.com/en/7", "allow"),
        ("http://net/de/1", "net/de/", "allow"),
        ("http://a.example.NET/de/7?casino", "net/de/", "allow"),
        ("http://a.example.net/de/81", "example.net/de/8", "block"),
        ("http://a.org/es/", "org/es/", "block"),
    ],
)
def test_url_rules_of_the_contract(spark, url, rule, verdict):
    r = url_filters.apply(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.rule, r.verdict) == (rule, verdict)


def test_url_empty(spark):
    assert url_filters.apply(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 6 classifier


def test_classifier(spark, sf, docs, none):
    from pyspark.sql import functions as F

    d, labels = common.table(spark, sf.replace("0.001", "0.01"), "documents"), common.table(spark, sf.replace("0.001", "0.01"), "labels")
    forest = quality_classifier.learn(d, labels)
    out = quality_classifier.apply(d, forest).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    got = quality_classifier.apply(docs, forest).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.apply(none, forest).count() == 0
    blank = quality_classifier.learn(d, labels.limit(0))
    assert quality_classifier.apply(d.limit(1), blank).first().score == 0.5


def test_statistics_by_brute_force():
    texts = [r[1] for r in awkward()]
    got = quality_classifier.statistics(texts)
    for t, x in zip(texts, got, strict=True):
        t = t or ""
        w = words(t)
        f = dict(zip(quality_classifier.FEATURES, x, strict=True))
        n = max(1, len(w))
        assert f["log_words"] == pytest.approx(np.log1p(len(w)))
        assert f["distinct_words"] == pytest.approx(len(set(w)) / n if w else 0)
        threes = Counter(zip(w, w[1:], w[2:], strict=False))
        assert f["repeat_threes"] == pytest.approx(sum(v for v in threes.values() if v > 1) / n)
        assert f["word_length"] == pytest.approx(sum(map(len, w)) / n)


def test_statistics_of_long_texts_are_those_of_the_whole(monkeypatch):
    passage = "Some words Here\n" + "x" * 700 + " and more of them, repeated.\nA line\n\n"
    texts = [passage * 5, "y" * 2500, "\n " * 900, passage, None, "a b c\n" * 400]
    whole = quality_classifier.statistics(texts)
    for piece in (999, 1000, 250):
        monkeypatch.setattr(codepoints, "PIECE", piece)
        assert np.array_equal(quality_classifier.statistics(texts), whole)


# 7 mixing


def brute_targets(sizes):
    total = 1.5 * sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] >= 2 * sizes[s]}
        if not over:
            return {**t, **{s: 2.0 * sizes[s] for s in capped}}
        capped |= over


def test_mixing(spark, docs, none):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice([None, "a", "a", "a", "a", "b", "c", "d"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(common.materialize(mixing.sizes(df), "sizes")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken % max(r["size"], 1) == 0 and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.mix(common.materialize(mixing.sizes(df.repartition(7)), "sizes")).collect()
    assert key(out) == key(again)
    mixed = mixing.apply(df)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.taken // r["size"] for r in out if r.taken})
    odd = mixing.mix(common.materialize(mixing.sizes(docs), "sizes"))
    assert odd.count() == docs.count() and mixing.apply(docs).columns == docs.columns
    assert mixing.mix(mixing.sizes(none)).count() == 0 and mixing.apply(none).count() == 0


def test_mix_of_coarse_documents(spark):
    """No document overruns the budget before finish time 2."""
    df = spark.createDataFrame([(1, "a", 1000), (2, "b", 1000)], "doc_id long, source string, size long")
    assert {r.doc_id: (r.target, r.taken) for r in mixing.mix(df).collect()} == {1: (2000.0, 2000), 2: (1000.0, 1000)}


# 8 HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site name</header>{nav}"
    "<div class='cookie-notice'>We use cookies</div>{body}<aside>Side</aside><form><input><label>Mail</label></form>"
    "<div id='comments'><p>Nice post!</p></div><footer>&copy; me</footer></body></html>"
)


def text(page, *near):
    return html_extraction.main_text(html_extraction.lines(page), *map(html_extraction.lines, near))


def test_html_markup():
    page = PAGE.format(nav="<nav><ul><li><a href='/'>Home</a></ul></nav>", body="<article><h1>A &amp; B</h1><p>One\n  <b>two</b>&nbsp;x<p>Three &lt;3<br></article>")
    assert html_extraction.main_text(html_extraction.lines(page)) == "A & B\nOne two x\nThree <3"
    assert html_extraction.main_text(html_extraction.lines(None)) == html_extraction.main_text(html_extraction.lines("")) == ""
    assert html_extraction.main_text(html_extraction.lines("<p>a<!-- open <p>b")) == "a"
    assert html_extraction.main_text(html_extraction.lines("<p>a < b &amp c")) == "a < b & c"
    assert text("<main><div>Trail</div><article><p>All of it</p></article></main>") == "All of it"
    assert text("<main><h1>Headline</h1><p>Lead</p><article>Teaser</article><p>Rest</p></main>") == "Headline\nLead\nTeaser\nRest"
    assert text("<main><h1>Headline</h1><div>Trail</div><article><p>Long enough to be most of it</p></article></main>") == "Headline\nLong enough to be most of it"
    named = "<h2 id='related-work'>Related work</h2><p class='notice-board'>Board</p><section id='legal-history'><p>Law</p></section>"
    for part in ("article", "main", "div"):
        assert text(f"<{part}>{named}</{part}>") == "Related work\nBoard\nLaw"
    assert text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == "So x=1 holds"
    assert text("<article><p>A</p><div class='comments'>Nice</div><div class='ad'>Buy</div><section id='comments'>More</section></article>") == "A"
    assert text("<div class='site-header'>S</div><div class='ad-box-1'>Buy</div><div id='side-bar'>B</div><p>A</p>") == "A"
    assert text("<article><svg viewBox='0 0'/><p>A</p></article>") == "A"
    assert html_extraction.main_text(html_extraction.lines("<div role='main'><p>A</p></div><p>b</p>")) == "A"


def test_html_differencing(spark):
    """Template lines without telling markup go because neighbours share them; copies keep theirs."""
    body = "<div>Top line of all</div><div><p>Own text {i}, a longer paragraph of this page alone, number {i}.</p></div><div>Read more here</div>"
    rows = [(i, f"http://h.example/a/{i}", PAGE.format(nav="", body=body.format(i=i))) for i in range(6)]
    rows += [(90, "http://c.example/1", "<p>Only text here, the same.</p>"), (91, "http://c.example/2", "<p>Only text here, the same.</p>")]
    rows += [(92, None, "<p>x</p>"), (93, None, "<p>x</p>"), (94, "http://z.example", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.apply(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    assert got[90][0] == got[91][0] == "Only text here, the same." and got[92][0] == "x" and got[94] == ("", 0)
    assert all(html_extraction.main_text(html_extraction.lines(rows[i][2])).startswith("Top line") for i in range(6))
    assert all(n == len(t) for t, n in got.values())


def test_html_differencing_of_neighbours():
    page = lambda i: html_extraction.lines(f"<div>Top line</div><p>Own text of page {i}, long enough to be most of it.</p><div>Read more</div>")
    assert html_extraction.main_text(page(1), page(2)) == "Own text of page 1, long enough to be most of it."
    assert html_extraction.main_text(page(1), page(1)).startswith("Top line")
    kept = html_extraction.lines("<article><p>Shared</p><p>Own words of the one page here</p></article>")
    other = html_extraction.lines("<article><p>Shared</p><p>Different words of another page</p></article>")
    assert html_extraction.main_text(kept, other) == "Shared\nOwn words of the one page here"


def test_html_differencing_inside_articles():
    """Short template lines inside an article go; paragraphs, and items of lists that differ, stay."""
    page = lambda i: html_extraction.lines(
        f"<article><div>Tell your friends</div><h2>Steps</h2><p>Shared</p><ul><li>Salt<li>Item {i}</ul><p>Own words of page {i}{' and more' * 20}</p>"
        "<ul><li>Mail this</ul><div>Be the first to answer</div></article>"
    )
    assert html_extraction.main_text(page(1), page(0), page(2)) == "Steps\nShared\nSalt\nItem 1\nOwn words of page 1" + " and more" * 20
    other = html_extraction.lines("<article><p>Nothing in common with the others.</p></article>")
    assert html_extraction.main_text(page(1), page(0), other).startswith("Tell your friends")


def test_html_differencing_does_not_depend_on_partitions(spark):
    """Few pages, each alone in its range, still find their neighbours."""
    body = "<div>Top line of all</div><div>Own text {i}, a longer paragraph of this page alone, number {i}.</div><div>Read more here</div>"
    rows = [(i, f"http://h{i % 3}.example/{i // 7}/{i}", PAGE.format(nav="", body=body.format(i=i))) for i in range(40)]
    rows += [(None, None, "<p>x</p>"), (41, "http://h1.example/1/8", None), rows[3], (3, rows[3][1], "<p>Another version</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = []
    for n in ("1", "3", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append(key(html_extraction.apply(df).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert {r.text for r in got[0] if r.page_id in range(4, 40)} == {f"Own text {i}, a longer paragraph of this page alone, number {i}." for i in range(4, 40)}


def test_html_copies_are_judged_by_what_is_left():
    menu = "".join(f"<div>Entry number {k} of the menu</div>" for k in range(16))
    page = lambda i: html_extraction.lines(f"{menu}<div>{f'Own words {i}. ' * 22}</div>")
    assert html_extraction.main_text(page(1), page(2)) == ("Own words 1. " * 22).strip()
    near = [html_extraction.lines(f"<div>Top</div><p>{'Long passage. ' * 30}</p><p>{f'Edit {i}. ' * 15}</p>") for i in range(2)]
    other = html_extraction.lines(f"<div>Top</div><p>{'Another text. ' * 30}</p>")
    assert html_extraction.main_text(near[0], near[1], other).split("\n")[0] == ("Long passage. " * 30).strip()


def test_html_runs_of_copies_are_compared_with_the_next_page_that_differs(spark):
    body = "<div>Top line of all</div><div>Own text {i}, a longer paragraph of this page alone, number {i}.</div><div>Read more here</div>"
    number = [0] * 9 + [1] + [2] * 30 + [3, 3]
    rows = [(i, f"http://h.example/{i:03}", body.format(i=k)) for i, k in enumerate(number)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for n in ("1", "5", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r.page_id: r.text for r in html_extraction.apply(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {i: f"Own text {k}, a longer paragraph of this page alone, number {k}." for i, k in enumerate(number)}


def brute_common(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@pytest.mark.parametrize("kinds", [1, 2, 3, 12, 60])
def test_common_subsequence(kinds):
    rnd = random.Random(kinds)
    for _ in range(60):
        a, b = ([rnd.randrange(kinds) for _ in range(rnd.randint(0, 60))] for _ in range(2))
        ours, theirs = html_extraction.common(a, b)
        assert [a[i] for i in ours] == [b[j] for j in theirs]
        assert all(i < j for x in (ours, theirs) for i, j in zip(x, x[1:], strict=False))
        assert len(ours) == brute_common(a, b)
        lengths = html_extraction._lengths(a, b)
        assert lengths.tolist() == [brute_common(a, b[:j]) for j in range(len(b) + 1)] if b else True


def test_html_long_pages_of_equal_lines_and_open_quotes():
    """Neither lines that repeat nor quotes that don't end cost the square of a page's length."""
    a = [1, 2] * 20_000 + [3]
    b = [2, 2, 1] * 12_000
    begun = time.time()
    assert len(html_extraction.common(a, b)[0]) >= 24_000
    page = "<a href='x>" * 40_001 + "end"
    assert html_extraction.lines(page)
    assert text("<a href='" * 40_001 + "end").endswith("end")
    assert time.time() - begun < 20


def site(rnd, named):
    """Pages of one host from templates whose menus, adverts and footers rotate; the article is in an element called ``named``."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    menus = [(" ".join(f"<li>{say(1)}</li>" for _ in range(4)), say(6), say(8)) for _ in range(10)]
    rows = []
    for i in range(120):
        menu, ad, foot = menus[rnd.randrange(10)]
        ps = [say(rnd.randint(3, 60)) for _ in range(rnd.randint(1, 8))]
        if i % 10 == 3:
            ps = [*rows[-1][1].split("\n")[1:], say(30)]  # an edited copy
        title = say(5)
        article = f"<{named}><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"<div class='end'>Read on at our site</div></{named}>"
        html = f"<html><body><div class='m1'><ul>{menu}</ul></div><div class='x9'>{ad}</div>{article}<div class='f1'>{foot}</div></body></html>"
        rows.append((html, "\n".join([title, *ps])))
    return rows


@pytest.mark.parametrize("named", ["article", "div"])
def test_html_differencing_extracts_by_itself(spark, named):
    """Neither element nor class names tell the template here; the same text whatever the number of ranges."""
    rows = site(random.Random(4), named)
    table = [(i, f"http://h.example/a/{i:03}", r[0]) for i, r in enumerate(rows)] + [(500, "http://other.example/", "<p>x</p>")]
    table += [(600 + i, "http://h.example/a/050", rows[50][0]) for i in range(20)]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    want = {i: r[1] for i, r in enumerate(rows)}
    for n in ("1", "4", "8", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r.page_id: r.text for r in html_extraction.apply(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(table)
        assert {i for i in want if got[i] != want[i]} == set(), n
        assert all(got[600 + i] == want[50] for i in range(20)) and got[500] == "x"


def brute_texts(rows):
    """(id, text) of (host, key, html) rows by comparing every page of a host with all within NEAR runs of it."""
    out = []
    for host in sorted({r[0] for r in rows}):
        runs = []
        for _, key_, page in sorted(r for r in rows if r[0] == host):
            if not runs or runs[-1][0] != page:
                runs.append((page, []))
            runs[-1][1].append(key_)
        own = [html_extraction.lines(page) for page, _ in runs]
        seen = [html_extraction.Seen(n, html_extraction.Page(x), x) for n, x in enumerate(own)]
        near = lambda n: range(max(0, n - html_extraction.NEAR), min(len(runs), n + html_extraction.NEAR + 1))
        for i in range(len(runs)):
            for j in near(i):
                if j < i:
                    seen[i].meet(seen[j])
        for i, (_, keys) in enumerate(runs):
            out += [(k, seen[i].text(seen[j] for j in near(i))) for k in keys]
    return sorted(out)


def test_html_windows_by_brute_force(spark):
    rnd = random.Random(8)
    pages = [r[0] for r in site(rnd, "div")]
    rows = [(f"h{min(rnd.randrange(9), 3)}.example", i, pages[rnd.randrange(len(pages))] if rnd.random() < 0.8 else pages[7]) for i in range(700)]
    table = [(i, f"http://{h}/p", page) for h, i, page in rows]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(5)
    want = brute_texts(rows)
    for n in ("1", "6", "90"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted((r.page_id, r.text) for r in html_extraction.apply(df).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_html_without_declared_articles(spark, sf):
    """The same texts with the articles' elements renamed."""
    pages = common.table(spark, sf, "pages")
    renamed = pages.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1div"))
    assert key(html_extraction.apply(pages).collect()) == key(html_extraction.apply(renamed).collect())



# 9 packing, 10 token files


def ids_of(text):
    return tokens.load(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_encode_equals_the_library():
    texts = [r[1] for r in awkward()] + ["don't we'll", "a  b\n\n c", "\x1c\x1d", "<|endoftext|> x", "²³ ½ 12a", "“quoted” – dash", "'S 'll", "tab\t\tx  ", "\x85\x85a"]
    for t, got in zip(texts, tokens.encode(tokens.default_tokenizer(), texts), strict=True):
        assert got.tolist() == ids_of(t)


def test_packing(docs, none):
    rows = packing.apply(docs, ids=True).collect()
    by_seq: dict = {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter(tuple([*ids_of(r.text), 2]) for r in docs.collect())
    got = Counter()
    texts: dict = {}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.piece)):
        texts.setdefault((r.doc_id, r.piece), r)
    for i in {k[0] for k in texts}:
        parts = [texts[k] for k in sorted(k for k in texts if k[0] == i)]
        whole = [x for p in parts for x in p.ids]
        assert tuple(whole) in want and [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(p.length == 1024 for p in parts[1:])
        got[tuple(whole)] += 1
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in want.items())
    assert packing.apply(none).count() == 0


@pytest.mark.parametrize("length", [16, 60])
def test_places_by_plain_minimisation(length):
    """Each piece goes where the sum of squared counts of open sequences per gap becomes smallest: the smallest gap of equals, a new one last."""
    r = np.random.default_rng(length)
    bins, load = packing.SumOfSquares(length), []
    for size in r.integers(1, length + 1, 400).tolist():
        counts = Counter(length - x for x in load if x < length)

        def after(gap, size=size, counts=counts):
            c = counts.copy()
            c[gap] -= gap < length
            c[gap - size] += gap > size
            return sum(n * n for n in c.values())

        best = min([g for g in counts if g >= size] + [length], key=lambda g: (after(g), g == length, g))
        where = bins.place(size)
        assert best == (length if where == len(load) else length - load[where])
        load += [0] * (where == len(load))
        load[where] += size


def test_pack_is_tight():
    r = np.random.default_rng(0)
    sizes = np.sort(r.integers(1, 1025, 3000))[::-1]
    at = packing.pack(sizes)
    load = np.bincount(at, weights=sizes)
    assert load.max() <= 1024 and (load > 0).all()
    assert len(load) <= 1.05 * sizes.sum() / 1024  # even lengths up to the sequence's: the hardest
    usual = np.sort(np.clip(r.lognormal(5.5, 1, 20_000).astype(int), 1, 1024))[::-1]
    assert packing.pack(usual).max() + 1 <= 1.002 * usual.sum() / 1024
    short = np.sort(r.integers(1, 400, 20_000))[::-1]
    assert packing.pack(short).max() + 1 <= 1.002 * short.sum() / 1024
    assert packing.pack(np.zeros(0, np.int64)).tolist() == []


def test_token_files(spark, docs, none):
    files = tokens.write(docs)
    got = tokens.starts(files).orderBy("start").collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    back = Counter((r.doc_id, tuple(r.tokens)) for r in files.collect())
    assert back == Counter((r.doc_id, tuple([*ids_of(r.text), 0])) for r in order)
    assert sum(r.crc for r in tokens.digests(files).collect()) == sum(n * zlib.crc32(np.array(t, "<u4").tobytes()) for (_, t), n in back.items())
    assert tokens.write(none).count() == 0


def test_token_file_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    files = tokens.write(docs)
    path = files.inputFiles()[0].replace("file:", "").rsplit("/", 1)[0]
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    cols = {m.row_group(0).column(k).path_in_schema: m.row_group(0).column(k) for m in meta if m.num_row_groups for k in range(m.num_columns)}
    assert cols["n_tokens"].has_column_index and cols["doc_id"].has_offset_index
    assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
    assert any("DICTIONARY" in e for n, c in cols.items() if n.startswith("tokens") for e in c.encodings)


def rows_read(df):
    """Rows that the scans of a query gave, as Spark counted them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_token_files_are_read_by_part(spark, tmp_path, monkeypatch):
    """Files kept in a folder; a few ids' rows are found without reading the other pages."""
    monkeypatch.setattr(tokens, "PAGE_ROWS", 100)
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('Some words of ', id) as text")
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tokens.write(docs, path=path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = tokens.read(spark, path)
    assert files.count() == 20_000
    few = tokens.select(files, ids=[7, 12_345, 99_999])
    assert {r.doc_id: r.tokens for r in few.collect()} == {i: [*ids_of(f"Some words of {i}"), 0] for i in (7, 12_345)}
    assert rows_read(few) <= 400
    some = tokens.select(files, low=5_000, high=5_100)
    assert sorted(r.doc_id for r in some.collect()) == list(range(5_000, 5_100)) and rows_read(some) <= 400
    numbers = tokens.counts(tokens.select(files, low=19_000))
    assert numbers.columns == ["doc_id", "n_tokens"] and "tokens" not in numbers._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].replace("n_tokens", "")


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}, {"normalizer": {"type": "Lowercase"}}, {"added": "Some"}])
def test_other_tokenizers_encode_as_the_library_does(tmp_path, change):
    made = json.load(open(tokens.default_tokenizer()))
    for k, v in change.items():
        if k == "normalizer":
            made[k] = v
        elif k == "added":
            made["added_tokens"].append({"id": 50_257, "content": v, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
        else:
            made["pre_tokenizer"][k] = v
    path = str(tmp_path / "other.json")
    json.dump(made, open(path, "w"))
    texts = ["cat, sat (x).", "Some More", "a  b\n"]
    plain = tokens.load(path)
    assert [x.tolist() for x in tokens.encode(path, texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not tokens.Pieces(path).splits and tokens.Pieces(tokens.default_tokenizer()).splits


def test_null_and_repeated_ids_are_spread(spark):
    """Neither token files nor the mix bring all rows of a null or repeated id into one task."""
    docs = spark.range(100_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "concat('w', id) as text", "'s' as source")
    files = tokens.write(docs)
    sizes = [r[0] for r in files.groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 50_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.apply(docs)
        per = [r[0] for r in mixed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per) == 150_000 and max(per) < 75_000


def test_shared_folder_is_named_on_clusters():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_url_vocabulary(spark):
    """A vocabulary of 100,000 terms, found between boundaries; kept columns of the same names stay."""
    terms = spark.range(100_000).selectExpr("concat('Term', id) as term", "if(id % 2 = 0, 'strict', 'soft') as weight")
    rows = [(1, "http://a.example/term4/x", "k1"), (2, "http://a.example/term5/x", "k2"), (3, "http://a.example/term5-term7", "k3"), (4, "http://a.example/term5/term5", "k4"), (5, "http://a.example/xterm4", "k5"), (6, None, "k6")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filters.apply(df, keep=("page_id", "host", "url"), terms=terms).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    assert (got[3].n_strict, got[3].n_soft, got[3].own_host, got[3].host, got[3].url) == (0, 2, "k3", "a.example", rows[2][1])
    assert {r.verdict for r in url_filters.apply(df, terms=terms.limit(0)).collect()} == {"allow"}


def test_refined_buckets_lose_no_pair(spark):
    """Members of a bucket that differ by 4 bits or fewer share a finer bucket."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    base = r.getrandbits(63)
    fps = [base] + [base ^ sum(1 << b for b in r.sample(range(63), r.randint(1, 4))) for _ in range(150)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    rows = df.select("fp", F.explode(simhash._buckets(F.col("fp"))).alias("b")).select("fp", "b", simhash._refined(F.col("b"), F.col("fp")).alias("f")).collect()
    by: dict = {}
    for x in rows:
        by.setdefault(x.b, []).append((x.fp, set(x.f)))
    for members in by.values():
        for i, (a, fa) in enumerate(members):
            for b, fb in members[:i]:
                own = [((a ^ b) >> low & (1 << width) - 1).bit_count() for low, width, _ in simhash.SEGMENTS]
                if sum(own) <= 4:
                    assert fa & fb
