"""The corpus operators where they are easily wrong: hot and huge values, repeated ids, missing neighbours, recall."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace
from urllib.parse import urljoin

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus import ODD, SCHEMA, components_by_force, docs, patterns, words
from tidemark.llm import langid, mixing, neardup, passages, pii, quality, shared, urls, vectors

DATA = "/root/testdata/sf0.001"


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(session)


# ---- vectors ----


def test_top_k_of_components_that_leave_the_range_of_doubles(spark):
    df = spark.createDataFrame([(0, [1e306, 1.0]), (1, [-1e306, 2.5]), (2, [0.0, -3.0]), (3, [5e-324, 0.1])], "vec_id long, embedding array<double>")
    whole = {r.vec_id: [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in r.embedding] for r in df.collect()}
    want = sorted(((max(min(sum(a * b for a, b in zip(whole[0], v, strict=True)), 2**63 - 1), -(2**63)), i) for i, v in whole.items() if i), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r.vec_id) for r in vectors.exact_top_k(df).orderBy("rank").collect()] == want
    near = vectors.permutation_search(df).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in near] == [(i, float("inf")) for i in (1, 2, 3)]


def test_an_id_of_many_rows_fills_no_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 16)
    rng = np.random.default_rng(3)
    rows = [(7 if i % 3 else i, [float(x) for x in rng.normal(size=5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vectors.exact_top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    part = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for q in {i for i, _ in rows if i % 50 == 0}:
        own = min(v for i, v in rows if i == q)
        own = [math.floor(256 * x) for x in own]
        assert got[q] == sorted(((i, sum(a * b for a, b in zip(v, own, strict=True))) for i, v in part if i != q), key=lambda x: (-x[1], x[0]))[:5]


@pytest.mark.parametrize("kind", ["table of 2,000", "20,000 normal", "20,000 in groups"])
def test_recall_of_the_permutation_index(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "table of 2,000":
        local = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
        ids, x, every = local.column("vec_id").to_numpy(), np.array(local.column("embedding").to_pylist(), float), 100
    else:
        x = rng.normal(size=(20_000, 64)) * (1 if kind == "20,000 normal" else 0.15)
        if kind == "20,000 in groups":
            x += rng.normal(size=(200, 64))[rng.integers(0, 200, len(x))]
        ids, every = np.arange(len(x)), 400
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = vectors.permutation_search(df, every=every).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got.query_id.nunique() == len(ids[ids % every == 0])
    hits = 0
    for q, rows in got.groupby("query_id"):
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        assert np.allclose(rows.score, distance[np.searchsorted(ids, rows.vec_id)], rtol=1e-12, atol=0)
        distance[ids == q] = np.inf
        hits += len({*ids[np.lexsort((ids, distance))[:10]]} & {*rows.vec_id})
    assert hits / len(got) >= 0.9


def test_a_query_visits_only_files_of_its_pivots():
    rng = np.random.default_rng(2)
    x, p = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    order = vectors.orders(x, p)
    files = vectors.post(order, 4)
    assert sum(map(len, files)) == 4 * len(x)
    assert all(sorted(f) == [i for i in range(len(x)) if j in order[i, :4]] for j, f in enumerate(files))
    places = vectors.ranks(order)
    want = [sum(abs(list(order[0]).index(j) - list(order[i]).index(j)) for j in range(40)) for i in range(20)]
    assert list(vectors.footrule(places[:20], places[0])) == want


# ---- personal data ----


@pytest.fixture(scope="module")
def field():
    return pii.fit_field()


LONG_LOCAL, LONG_DOMAIN = "averyveryverylongname.indeedwithmuch", "averyveryverylongdomainnameindeed"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("0" * 5000 + ".1.1.1", "[IP]"),
        ("9" * 5000 + ".1.1.1 ok", "9" * 5000 + ".1.1.1 ok"),
        (f"mail {LONG_LOCAL} (at) site (dot) com ok", "mail [EMAIL] ok"),
        (f"mail joe (at) {LONG_DOMAIN} (dot) com ok", "mail [EMAIL] ok"),
        (f"mail joe @ {LONG_DOMAIN}.com ok", "mail [EMAIL] ok"),
        ("word " * 20_000 + "x@y.zz" + " word" * 20_000, "word " * 20_000 + "[EMAIL]" + " word" * 20_000),
    ],
)
def test_long_entities_and_texts(spark, field, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(pii.redacted(df["text"], field)).first()[0] == want
    row = pii.pii_digest(df, field).first()
    base = sorted(pii.base_spans(text))
    assert (row.n_email, row.n_ip) == (sum(k == 0 for k, *_ in base), sum(k == 1 for k, *_ in base))
    assert row.spans == pii._listed(pii.all_spans(text, field)[1]) and bool(row.spans) == (want != text)


def test_zones_hold_whole_words_and_never_overlap():
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice([*"abcdefgh", " ", " ", "\n", "1", "@", " (at) "], 200, p=[0.095] * 8 + [0.08, 0.08, 0.02, 0.02, 0.02, 0.02]))
        found = list(pii.zones(text))
        assert all(a < b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
        held = {i for a, b in found for i in range(a, b)}
        assert {i for i, c in enumerate(text) if c in "1@"} <= held
        for a, b in found:
            assert a == 0 or text[a - 1].isspace() or text[a].isspace()
            assert b >= len(text) or text[b].isspace() or text[b - 1].isspace()


# ---- passages ----


@pytest.mark.parametrize("n", [0, 30, 35, 40, 45, 49])
def test_a_first_document_with_part_of_a_passage(spark, n):
    rng = np.random.default_rng(n)
    prose = lambda size: [f"w{x}" for x in rng.integers(0, 10**6, size)]
    texts = []
    for _ in range(12):
        passage = prose(50)
        texts += [" ".join(prose(40) + part + prose(40)) for part in (passage[:n], passage, passage)]
    rows = {r.doc_id: r for r in passages.repeated_passages(docs(spark, texts)).collect()}
    for i in range(0, len(texts), 3):
        assert i + 2 in rows and rows[i + 2].first_doc_id == i + 1 and rows[i + 2].start <= 40 and rows[i + 2].end >= 90
        assert i not in rows and i + 1 not in rows


def test_a_passage_whose_minima_stand_in_several_earlier_documents(spark):
    rng = np.random.default_rng(5)
    prose = lambda size: [f"w{x}" for x in rng.integers(0, 10**6, size)]
    passage = prose(60)
    texts = [" ".join(prose(20) + passage[a : a + 12] + prose(60)) for a in range(0, 50)]  # every shingle, never 50 words
    texts += [" ".join(prose(50) + passage + prose(50)) for _ in range(3)]
    rows = passages.repeated_passages(docs(spark, texts)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in rows} == {(51, 50), (52, 50)} and all(r.start <= 50 and r.end >= 110 for r in rows)


def test_near_passages_whose_minima_stand_in_several_earlier_documents(spark):
    """No 50 words in a row are equal, and every shingle has another first document than the near copy."""
    rng = np.random.default_rng(8)
    prose = lambda size: [f"w{x}" for x in rng.integers(0, 10**6, size)]
    texts, wanted = [], []
    for _ in range(30):
        passage = prose(80)
        texts += [" ".join(prose(20) + passage[a : a + 12] + prose(60)) for a in range(0, 70, 5)]
        wanted.append((len(texts) + 1, len(texts)))
        texts += [" ".join(prose(50) + p + prose(50)) for p in (passage, passage[:40] + prose(1) + passage[41:])]
    rows = passages.repeated_passages(docs(spark, texts)).collect()
    got = {(r.doc_id, r.first_doc_id) for r in rows if r.start <= 52 and r.end >= 128}
    assert got <= set(wanted) and len(got) >= 0.9 * len(wanted), len(got)


def test_passages_of_repeated_ids_and_a_long_text(spark):
    rng = np.random.default_rng(6)
    prose = lambda size: [f"w{x}" for x in rng.integers(0, 10**6, size)]
    long = prose(300_000)
    rows = [(1, " ".join(long)), (2, " ".join(prose(10) + long[290_000:290_200])), (2, "short"), (3, None), (4, " ".join(long[:60])), (None, " ".join(long))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id, r.start, r.end) for r in got} == {(2, 1, 10, 210), (4, 1, 0, 60)}


# ---- near-duplicates ----


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    df = docs(spark, ["a b c d", "zz yy xx ww", "zz yy xx ww", "zz yy xx ww", "a b c d", None, "q r s t", None, "a b c d"], ids=[7, 7, 9, 8, 3, 8, 11, 12, None])
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == {(7, 2, 3, False), (9, 2, 3, False), (8, 2, 3, False), (8, 0, 3, False), (3, 2, 3, True), (11, 2, 11, True), (12, 0, 12, True), (None, 2, None, True)}


@pytest.mark.parametrize(("k", "percent", "own", "between"), [(3, 85, 14, 4), (5, 80, 12, 3)])
def test_a_region_of_thousands(spark, k, percent, own, between):
    """Over 2,000 documents of one template, too far apart to be linked, and near copies of some of them."""
    rng = np.random.default_rng(k)
    template, texts = [f"w{i}" for i in range(240)], []

    def changed(text, n):
        new = list(text)
        for at in rng.choice(240 // k, n, replace=False):
            new[k * at + 1] = f"x{rng.integers(1 << 40)}"
        return new

    for i in range(2_000):
        texts.append(changed(template, own))
        if i % 16 == 0:
            texts.append(changed(texts[-1], between))
    shingles = [{hash(tuple(t[j : j + k])) for j in range(len(t) - k + 1)} for t in texts]
    number = {}
    for s in shingles:
        for x in s:
            number[x] = number.get(x, 0) + 1
    place = {x: i for i, x in enumerate(x for x, n in number.items() if n > 1)}
    hot = np.zeros((len(texts), len(place)), np.float32)
    for i, s in enumerate(shingles):
        hot[i, [place[x] for x in s if x in place]] = 1
    both, size = (hot @ hot.T).astype(int), np.array([len(s) for s in shingles])
    a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None] - both), 1))
    label = np.arange(len(texts))
    for i, j in zip(a, b, strict=True):
        label[label == label[j]] = label[i]
    assert 100 < len(a) < 400
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, [" ".join(t) for t in texts]), k, percent).collect()}
    first = {}
    for i, c in enumerate(label):
        first.setdefault(c, i)
    assert [got[i] for i in range(len(texts))] == [first[c] for c in label]


# ---- mixing, language, quality ----


def test_mixing_keeps_columns_of_any_name(spark):
    df = docs(spark, ["a b", "c", None, "", "d e f"])
    for name in ("of", "last", "copies", "copy", "row", "mix_source", "size", "taken"):
        df = df.withColumn(name, F.lit(name))
    got = mixing.mix_documents(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} <= {0, 1, 4} and got.where("last != 'last' or copies != 'copies'").count() == 0


def test_pooled_probabilities_are_those_of_the_network():
    rng = np.random.default_rng(1)
    net = langid.ByteNetwork(["a", "b", "c"])
    texts = [None, "", "x", "é" * 100, "".join(map(chr, rng.integers(32, 500, 300)))]
    got = net.pooled(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        total = np.zeros(3)
        for low in range(0, len(data), langid.WINDOW):  # step by step, as in training
            x = data[low : low + langid.WINDOW]
            padded = np.zeros((langid.WINDOW, 1), np.uint8)
            padded[: len(x), 0] = x
            states = np.concatenate([net._forward(d, padded)["h"] for d in "fb"], 2)
            total += net._probabilities(states)[: len(x), 0].sum(0)
        assert np.allclose(row, total / max(len(data), 1), atol=1e-4)


def test_quality_features_and_scores_by_hand():
    texts = [None, "", "Hello hello WORLD 12", "a b, c! d| |\n\nx.", "é ü #tag #tag", "\t \n"]
    x = quality.text_features(pa.array(texts))
    for text, row in zip(texts, x, strict=True):
        raw, w = (text or "").encode(), words(text)
        if not raw:
            assert not row.any()
            continue
        n, many = len(raw), max(len(w), 1)
        letters = sum(chr(c).isalpha() and c < 128 or c >= 128 for c in raw)
        rare = [c for c in raw if 32 < c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?"]
        assert row[0] == pytest.approx(math.log1p(len(w))) and row[2] == pytest.approx(sum(65 <= c <= 90 for c in raw) / max(letters, 1))
        assert row[3] == pytest.approx(sum(48 <= c <= 57 for c in raw) / n) and row[5] == pytest.approx(len(rare) / n)
        assert row[8] == pytest.approx(raw.count(b"\n") / many) and row[10] == pytest.approx(len({*w}) / many)
        assert row[11] == pytest.approx(sum(a == b for a, b in zip(w, w[1:], strict=False)) / many)
        assert row[12] == pytest.approx(sum(len(v.encode()) == 1 for v in w) / many) and row[14] == pytest.approx(max((rare.count(c) for c in rare), default=0) / many)
    rng = np.random.default_rng(0)
    train = rng.normal(size=(400, 3))
    model = quality.AdditiveModel(train, (train[:, 0] * train[:, 1] > 0).astype(float))
    for row, got in zip(train[:50], model.predict(train[:50]), strict=True):
        bins = [int((row[j] >= edges).sum()) for j, edges in enumerate(model.edges)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i], bins[j]] for i, j, t in model.pairs)
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.predict(train) > 0.5) == (train[:, 0] * train[:, 1] > 0)).mean() > 0.9


# ---- URLs ----


def test_verdicts_over_many_edges_match_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    hosts, paths = [*(f"H{i}.net" for i in range(60)), *["a.example.org", "b.com"] * 10, "b.org"], ["/es/1", "/en/12", "/de/x", "/fr/y", "/p/q", "/", ""]
    url = lambda: f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=' + str(rng.integers(5)), '#z'])}"

    def html():
        kind, to = rng.integers(8), rng.choice([url(), f"http://b.com/de/{rng.integers(40)}", f"http://a.example.org/es/{rng.integers(40)}", "/es/1", "//c.net/p/q", "q", "./q?a=1&amp;b=2", "?q=3", "#top", "mailto:a@b", "../up", "", "../../es/x/./..?q=../z", "/a/./b/../../es/2", "..", "x/.", "/../../de/4"])
        tags = [f'<link rel="canonical" href="{to}">', f"<LINK href={to} rel=canonical>", f'<meta http-equiv="refresh" content="0; url={to}">', f'<link rel="stylesheet" href="{to}">', "<link <link <p>", None, f'<link rel="canonical" href="{to}"><link rel="canonical" href="{url()}">', ""]
        return tags[kind]

    rows = [(i, None if i == 7 else "nothing" if i == 8 else url(), html()) for i in range(200)]
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path / 'pages.parquet'}'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.URL_SQL}) ORDER BY page_id").fetchall()
    got = urls.url_verdicts(spark.read.parquet(str(tmp_path / "pages.parquet"))).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == want
    assert sum(r.rule is None and r.verdict == "block" for r in got) > 3


def test_dot_segments_are_resolved_as_a_browser_does(spark):
    ways = ["/a/b/../c", "/a/./b", "/..", "/../../x", "/a/b/..", "/a/b/.", "/a/..?q=../z", "/a/b", "/a/.../b", "/.", "/a//../b", "/a/..b/c", "/x/y/../../../z?k=1", "/", "/%C3%A9/../é#../t"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "i int, w string")
    got = {r.i: r.to for r in df.select("i", urls._settled(F.col("w")).alias("to")).collect()}
    assert got == {i: urljoin("http://h/", w)[len("http://h") :] for i, w in enumerate(ways)}


def test_an_open_tag_is_not_searched_again_and_again(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "<link rel=" * 100_000)], "page_id long, url string, html string")
    assert urls.url_verdicts(df).first().verdict == "allow"


# ---- pipeline ----


def test_stages_of_odd_rows(spark, tmp_path):
    texts = [*ODD, "mail a@b.cc now", "mail a@b.cc now", "", None]
    df = docs(spark, texts, ids=[*range(len(texts) - 2), 3, None])
    for table in ("labels",):
        os.symlink(f"{DATA}/{table}.parquet", tmp_path / f"{table}.parquet")
    rows = df.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        got = out.collect()
        if name != "bpe":
            assert out.columns == df.columns
        if name == "near_dedup":
            _, label = components_by_force([r.text for r in rows[:-2]], 5, 80)
            ids = [r.doc_id for r in got]
            assert sorted(i for i in ids if i is not None) == sorted({*label}) and ids.count(None) == 1
        elif name == "personal_data":
            assert [r.text is None for r in got] == [r.text is None for r in rows] and not any(patterns(r.text or "") for r in got)
        elif name == "bpe":
            assert len(got) == len(rows)
        elif name == "mixing":
            assert all(words(r.text) for r in got)
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def shape(kind, text):
    """An entity's form: its kind, with runs of letters and of digits named by their length."""
    if kind == 1:
        return "ip", " " in text
    if kind == 0:
        return "email", "(" in text, "[" in text, "@" in text, " " in text
    return kind, re.sub("[0-9]+", lambda m: str(len(m[0])), text)


def test_every_form_is_found_in_fresh_sentences(field):
    rng = random.Random(4321)
    there, found, added, right = Counter(), Counter(), 0, 0
    for _ in range(3000):
        text, spans = pii._sentence(rng)
        got = set(pii.all_spans(text, field)[1])
        for k, a, b in spans:
            there[shape(k, text[a:b])] += 1
            found[shape(k, text[a:b])] += (k, a, b) in got
        own = field.spans(text)
        added, right = added + len(own), right + sum(s in spans for s in own)
    assert {s for s, n in there.items() if n >= 20 and found[s] < 0.97 * n} == set()
    assert found.total() >= 0.99 * there.total() and right >= 0.99 * added
    assert (3, "3-3-4") in there and found[3, "3-3-4"] >= 0.99 * there[3, "3-3-4"]


@pytest.mark.parametrize("text", ["call 415-555-2671 ok", "tel 020 7946 0958", "a 10.2.3.4, b (at) c (dot) org", "1-212 (333) 4", "no entity 12"])
def test_the_dynamic_programs_are_sums_over_all_segmentations(field, text):
    tokens = pii._tokens(text, 0, len(text))
    lattice = field.lattice(text, tokens)

    def every(i):
        """All segmentations from token i on, as (score, spans)."""
        if i == len(tokens):
            yield 0.0, ()
            return
        for score, spans in every(i + 1):
            yield score, spans
        for after, _, scores in lattice[i]:
            for k, own in enumerate(scores):
                for score, spans in every(after):
                    yield score + own, ((k, tokens[i][0], tokens[after - 1][1]), *spans)

    known = [*every(0)]
    total = np.logaddexp.reduce([s for s, _ in known])
    ahead, back = field.sums(lattice)
    assert ahead[-1] == pytest.approx(total) and back[0] == pytest.approx(total)
    best = max(known)[1]
    # Zones reach over all of these short texts, so the field sees the same tokens.
    got = field.scored(text)
    assert sorted(s for s, _ in got) == sorted(best)
    for span, posterior in got:
        assert posterior == pytest.approx(sum(np.exp(s - total) for s, spans in known if span in spans))


def test_texts_side_by_side_have_the_sums_of_each(field):
    rng = random.Random(5)
    sentences = [pii._sentence(rng) for _ in range(30)]
    many = pii._Lattices.of(sentences)
    ahead, back = many.sums(many.x @ field.weights.T)
    for k, (text, _) in enumerate(sentences):
        tokens = pii._tokens(text, 0, len(text))
        one_ahead, one_back = field.sums(field.lattice(text, tokens))
        assert np.allclose(ahead[k, : len(tokens) + 1], one_ahead) and np.allclose(back[k, : len(tokens) + 1], one_back)


def test_added_spans_touch_no_base_span():
    class Says:
        def spans(self, text):
            return [(3, a, a + 5) for a in range(0, len(text), 3)]

    text = "a@b.cc 1.2.3.4 x y z 12.13.14.15@q.com 4111 1111 1111 1111 end" * 3
    base, both = pii.all_spans(text, Says())
    assert set(both) - set(base) == {s for s in Says().spans(text) if not any(s[1] < b and a < s[2] for _, a, b in base)}
