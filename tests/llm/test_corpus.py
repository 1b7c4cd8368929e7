"""The corpus operators: brute force on small fixtures, odd rows, held-out accuracy."""

import glob
import hashlib
import os
import re
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, bpe_batch, components, langid, mixing, neardup, passages, pii, quality, queries, urls, vectors

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, rank int, component string"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "x", "y", 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   \n\t", "one", "two words", "!!!", "éàü ñ", "word " * 5000, "12 34", "a\x1cb\x85c d", "same text here now", "same text here now"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and all(((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all() for c in columns)


# ---- vectors ----


def test_top_k_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(2)], "c", 1) for i in range(0, 120)]
    rows += [(200, None, "c", 1), (201, [1.0, None], "c", 1), (202, [float("nan"), 1.0], "c", 1), (203, [float("inf")], "c", 1), (204, [], "c", 1), (205, [2.0], "c", 1), (None, [1.0], "c", 1), (50, rows[50][1], "c", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    got = defaultdict(list)
    for r in vectors.exact_top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    part = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 50, 100):
        vector = next(v for i, v in part if i == q)
        want = sorted(((i, sum(a * b for a, b in zip(v, vector, strict=False))) for i, v in part if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == want
    assert set(got) == {0, 50, 100}


def test_top_k_of_huge_components_and_of_nothing(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vectors.exact_top_k(df).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]
    assert vectors.exact_top_k(df.limit(0)).count() == 0 and vectors.permutation_search(df.limit(0)).count() == 0


def test_ties_in_a_block_go_to_smaller_ids():
    assert list(vectors.top_k(np.array([3, 1, 3, 3, 2]), np.array([10, 11, 12, 13, 14]), 2)) == [0, 2]


def test_permutation_search_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    extra = spark.createDataFrame([(900, [0.0] * 64), (1000, None)], "vec_id long, embedding array<float>")
    got = vectors.permutation_search(df.select("vec_id", "embedding").union(extra)).toPandas()
    local = df.toPandas()
    x, ids, hits = np.stack(local.embedding).astype(float), local.vec_id.to_numpy(), 0
    assert not {900, 1000} & {*got.vec_id, *got.query_id}
    for q, rows in got.groupby("query_id"):
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        assert np.allclose(rows.score, [distance[ids == i][0] for i in rows.vec_id], rtol=1e-14, atol=0)
        assert list(rows.sort_values("rank").score) == sorted(rows.score)
        distance[ids == q] = np.inf
        hits += len({*ids[np.lexsort((ids, distance))[:10]]} & {*rows.vec_id})
    assert hits / len(got) >= 0.9


# ---- personal data ----


def patterns(text):
    """The contract's patterns as regular expressions, slow and plain."""
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 8 <= len(d) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab1@.+- ()25é%_\n", "12", "255.", "1.2.3.4", "a@b.c", "+1 (2", "4111 1111 1111 1111", "4539578763621486"]), max_size=25).map("".join))
def test_base_spans_are_the_patterns(text):
    assert sorted(pii.base_spans(text)) == patterns(text)


@pytest.fixture(scope="module")
def field():
    return pii.fit_field()


def test_field_adds_what_patterns_miss_and_leaves_prose_alone(field):
    def found(text):
        return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.all_spans(text, field)[1]]

    assert found("call (555) 234-5678 now") == [("phone", "(555) 234-5678")]
    assert found("mail joe (at) site (dot) com ok") == [("email", "joe (at) site (dot) com")]
    for clean in ("order 1234567890 of 2024-01-02 at 10:30", "version 1.2.3 costs 1,234,567", "4736962573099582 is no card", "hash 2abc3ff2ca8fb1e4c565a0eb63815530"):
        assert found(clean) == []


def test_bracketed_signs_need_no_digit(spark, field):
    texts = ["mail joe (at) site (dot) com ok", "mail joe [AT] site [Dot] org ok", "joe( at )site( dot )net", "a ( b ) [c] {d}", "it was (at", "joe at site {dot} com ok", "(", None]
    want = [pii.all_spans(t or "", field)[1] for t in texts]
    assert [len(x) for x in want[:2]] == [1, 1]
    df = docs(spark, texts).coalesce(1)
    got = {r.doc_id: r.spans for r in pii.pii_digest(df, field).collect()}
    assert [got[i] for i in range(len(texts))] == [pii._listed(x) for x in want]
    new = {r.doc_id: r.new for r in df.select("doc_id", pii.redacted(df["text"], field).alias("new")).collect()}
    assert new[0] == "mail [EMAIL] ok" and new[1] == "mail [EMAIL] ok" and new[3] == texts[3] and new[7] is None


def test_pii_digest_of_odd_rows(spark, field):
    texts = [*ODD, "é x@y.zz and 1.2.3.4"]
    got = {r.doc_id: r for r in pii.pii_digest(docs(spark, texts), field).collect()}
    for i, text in enumerate(texts):
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in patterns(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[12].n_email, got[12].n_ip, got[12].spans) == (1, 1, "email:2:8,ip:13:20")
    assert pii.pii_digest(docs(spark, texts).limit(0), field).count() == 0


# ---- mixing ----


def test_mix_matches_queueing_by_hand(spark):
    texts = [" ".join(["w"] * n) for n in [3, 0, 7, 2, 9, 4, 1, 8, 5, 6, 40, 2]] + [None]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in mixing.fair_mix(df).collect()}
    queues = defaultdict(list)
    for r in df.collect():
        queues[r.source].append((hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id, len(words(r.text))))
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(x[2] for x in queues[s]) for s in order}
    total, weight = sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * weight[s] > 3 * sizes[s] * w}
        if not over:
            break
        capped |= over
    target = {s: float(3 * sizes[s]) if s in capped else weight[s] * rest / w for s in order}
    copies = []
    for rank, s in enumerate(order):
        for e in range(3):
            running = e * sizes[s]
            for key, i, n in sorted(queues[s]):
                running += n
                copies.append((running / target[s], rank, key, i, n))
    taken, used = defaultdict(int), 0
    for *_, i, n in sorted(copies):
        used += n
        if used <= total:
            taken[i] += n
    for i, r in got.items():
        assert r.taken == taken[i] and r.target == target[r.source] and r.source_size == sizes[r.source]
    mixed = [r.doc_id for r in mixing.mix_documents(df).collect()]
    assert {i: mixed.count(i) * got[i].size for i in got} == {i: taken[i] for i in got}
    assert mixing.fair_mix(df.limit(0)).count() == 0


# ---- language, quality ----


def test_language_held_out_accuracy_and_odd_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_language(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() >= 0.97 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in langid.predict_language(docs(spark, ODD)).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 5, 8)] == ["und"] * 5 and odd[3].lang_pred == "en"
    assert langid.predict_language(docs(spark, ODD).limit(0)).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = langid.ByteNetwork(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, weight = rng.integers(0, 256, (5, 3)), rng.normal(size=(5, 3, langid.HIDDEN))
    for d in "fb":
        states = net._forward(d, x)
        slope = net._backward(d, x, states, weight)
        for name in (f"U{d}", f"E{d}", f"b{d}"):
            at = tuple(rng.integers(0, s) for s in net.w[name].shape) if name[0] != "E" else (int(x[2, 1]), 4)
            loss = []
            for e in (1e-3, -1e-3):
                net.w[name][at] += e
                loss.append((net._forward(d, x)["h"].astype(float) * weight).sum())
                net.w[name][at] -= e
            assert slope[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=2e-2, abs=2e-3)


def test_quality_held_out(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(df, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and got[got.quality == 1].predicted.mean() >= 0.99


def test_quality_of_odd_rows_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs(spark, ODD), labels).collect()} == {0.5}
    assert quality.score_quality(docs(spark, ODD).limit(0), labels).count() == 0


# ---- passages and near-duplicates ----


def texts_with_copies(seed):
    rng = np.random.default_rng(seed)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base = [prose(int(n)) for n in rng.integers(5, 300, 25)]
    out = list(base)
    for _ in range(40):
        copy = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, max(2, len(copy) // 25))):
            copy[rng.integers(len(copy))] = f"w{rng.integers(5000)}"
        out.append(copy)
    return [" ".join(x) for x in out] + [None, "", "  ", "w1", "W1", "w1 w2"]


def components_by_force(texts, k, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sets, label


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, k, percent):
    texts = texts_with_copies(k)
    sets, label = components_by_force(texts, k, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts), k, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == label
    assert all(got[i].kept == (label[i] == i) for i in got)


def test_large_regions_are_cut_deeper_and_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 4)
    texts = texts_with_copies(9)
    _, label = components_by_force(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_copies_among_many_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    rng = np.random.default_rng(12)
    template, texts = [f"w{i}" for i in range(200)], []

    def changed(text, n):
        new = list(text)
        for at in rng.choice(66, n, replace=False):
            new[3 * at + 1] = f"x{rng.integers(1 << 40)}"
        return new

    for i in range(260):
        texts.append(changed(template, 4))
        if i % 8 == 0:
            texts.append(changed(texts[-1], 5))
    texts = [" ".join(x) for x in texts]
    _, label = components_by_force(texts, 3, 85)
    assert sum(x != i for i, x in enumerate(label)) > 20
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    df = docs(spark, ["a b c d", "a b c d", "x y z", "x y z"], ids=[7, 7, None, 3])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect())
    assert got == [(False, 3, 3, True), (False, 7, 7, True), (False, 7, 7, True), (True, 0, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(200, i) for i in range(100, 200)] + [(i, i + 1) for i in range(300, 340)] + [(None, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if x is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    loops = {x for x in label if not any(x in e and e[0] != e[1] for e in edges if None not in e)}
    assert got == {x: c for x, c in label.items() if x not in loops}


def test_passages_cover_every_repeat(spark):
    rng = np.random.default_rng(7)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 9000, n)]
    shared = [prose(60) for _ in range(4)]
    texts = []
    for i in range(30):
        body = prose(int(rng.integers(20, 200)))
        if i % 2:
            at = int(rng.integers(0, len(body)))
            body[at:at] = shared[i % 4]
        texts.append(" ".join(body))
    near = list(shared[1])
    near[30] = "changed"
    texts += [" ".join(prose(30) + near + prose(30)), None, "", "short", " ".join(shared[1][:40])]
    rows = passages.repeated_passages(docs(spark, texts)).collect()
    covered = defaultdict(list)
    for r in rows:
        assert r.end - r.start >= 50 and r.first_doc_id < r.doc_id
        covered[r.doc_id].append((r.start, r.end))
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - 49):
            window = tuple(w[j : j + 50])
            if seen.setdefault(window, i) != i:
                assert any(a <= j and j + 50 <= b for a, b in covered[i]), (i, j)
    assert covered[30] and not {31, 32, 33, 34} & set(covered)
    assert all(i % 2 or i == 30 for i in covered)
    assert passages.repeated_passages(docs(spark, texts).limit(0)).count() == 0


def test_stretches_of_many_texts_are_hashed_together(spark):
    """Keys agree exactly where stretches do; ranges that overlap are one, and those beyond a text hold nothing."""
    words = [f"w{i % 7}" for i in range(60)]
    texts = {1: words, 2: words[7:40] + ["x"], 3: ["y"] + words[:30], 4: words[:4]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    ranges = [(1, 0, 12), (1, 8, 20), (1, 50, 90), (2, 0, 30), (3, 3, 26), (3, 100, 120), (4, 0, 9)]
    got = passages.stretches(spark.createDataFrame(ranges, "doc_id long, low int, high int"), docs, 5, 11).collect()
    merged = [(1, 0, 20), (1, 50, 56), (2, 0, 30), (3, 3, 26)]
    want = {(d, tuple(texts[d][i : i + 15])) for d, low, high in merged for i in range(low, min(high, len(texts[d]) - 4) - 10)}
    assert len(got) == len(want)
    count = lambda pairs: sorted(sorted(d for d, k in pairs if k == key) for key in {k for _, k in pairs})
    assert count([(r.doc_id, r.key) for r in got]) == count([*want])
    tokens = np.arange(500, dtype=np.uint64) % np.uint64(90)
    for width in (1, 2, 3, 46, 500):
        keys = passages.stretch_hashes(tokens, width)
        assert len(keys) == 501 - width and len(set(keys.tolist())) == min(90, 501 - width) and not len(passages.stretch_hashes(tokens[: width - 1], width))


def test_all_texts_of_a_first_document_are_compared(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b = words("a", 60), words("b", 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, *words("c", 40), *b]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.start, r.end, r.first_doc_id) for r in got} == {(2, 0, 60, 1), (2, 100, 160, 1)}


def test_windows_meet_where_enough_hash_functions_cover_a_place():
    kind = pa.list_(pa.struct([("hash", pa.int8()), ("place", pa.int32()), ("left", pa.int32()), ("right", pa.int32())]))
    spot = lambda *x: dict(zip(("hash", "place", "left", "right"), x, strict=True))
    lists = [[spot(0, 10, 5, 5), spot(1, 20, 5, 5)], [spot(0, 10, 5, 5), spot(1, 20, 4, 5)], [spot(0, 10, 5, 5), spot(0, 12, 5, 5)], [spot(3, 0, 0, 0), spot(1, 0, 0, 0)]]
    assert passages.meet(pa.array(lists, kind)).tolist() == [True, False, False, True]


def test_compact_windows_part_all_stretches():
    rng = np.random.default_rng(1)
    tokens, starts, width = rng.integers(0, 40, 60).astype(np.uint64), np.array([0, 25, 25, 60]), 6
    for minimum, row, place, left, right in passages.compact_windows(tokens, starts, width):
        for r in range(3):
            n = starts[r + 1] - starts[r]
            own = [(p - a, p, p + b) for p, a, b, o in zip(place, left, right, row, strict=True) if o == r]
            for a in range(n):
                for b in range(a + width - 1, n):
                    assert sum(lo <= a <= c <= b <= hi for lo, c, hi in own) == 1
        assert len(minimum) == len(row)


# ---- BPE ----


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["'", "s", "re", "'ll", "<|endoftext|>", "<|start", "Σ", "É", " ", "\n", "\x1c", "\x85", "A", "9", "#!", "İ", "ß", "中", "\ua7dc", "\U00010d50", "a" * 90]), max_size=12).map("".join)))
def test_bpe_is_the_library(library, text):
    import unicodedata

    if any(unicodedata.category(c) == "Cs" for c in text):  # lone surrogates are no text
        return
    own, ids = bpe_batch.batch_encoder(VOCAB), library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    assert [*own.both([text, "", text])] == [(len(ids), " ".join(map(str, ids)), decoded), (0, "", ""), (len(ids), " ".join(map(str, ids)), decoded)]
    assert bpe.encoder(VOCAB).decode(ids) == decoded


def test_cuts_are_certain():
    own = bpe.encoder(VOCAB)
    word = "thexqzjand"
    pieces = own.cuts(word)
    assert "".join(pieces) == word and all((a[-1], b[0]) not in own.inner for a, b in zip(pieces, pieces[1:], strict=False))


def test_bpe_digest_of_odd_rows(spark, library, documents):
    sample = [*ODD, *[r.text for r in documents.limit(30).collect()]]
    got = {r.doc_id: r for r in bpe_batch.bpe_digest(docs(spark, sample), VOCAB).collect()}
    for i, text in enumerate(sample):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    row = bpe_batch.bpe_encode(docs(spark, ["hello world"]), VOCAB).first()
    assert row.ids == library.encode("hello world").ids


# ---- URLs ----


def test_blocks_spread_over_aliases(spark):
    link = lambda to: f'<html><head><link href="{to}" rel="canonical"></head>'
    refresh = lambda to: f'<META http-equiv="refresh" content="0; url={to}">'
    rows = [
        (1, "https://www.Example.org/es/1", "", 1), (2, "http://a.net/x", link("https://www.example.org/es/1#top"), 1), (3, "http://a.net/y?q=1", refresh("/x"), 1), (4, "http://b.com/fr/z", link("http://a.net/x"), 1),
        (5, "http://c.net/alone", None, 1), (6, None, link("http://a.net/x"), 1), (7, "no scheme", "", 1), (8, "http://d.com/de/1", "", 1), (9, "http://e.net/p", link("http://d.com/de/1"), 1), (9, "http://e.net/p", link("http://d.com/de/1"), 1), (10, "http://good.org/a", link("http://d.com/de/1"), 1),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string, component int")).collect()}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    # An alias that a rule allows speaks for the pages without a rule.
    assert got[2] == ("a.net", "/x", None, "allow") and got[3][3] == "allow" and got[4][2:] == ("com/fr/", "allow")
    assert got[5][3] == got[6][3] == got[7][3] == "allow" and got[6][:2] == got[7][:2] == ("", "")
    assert got[8][2:] == ("com/de/", "block") and got[9][3] == "allow" and got[10][2:] == ("org/", "allow")
    apart = {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame([r for r in rows if r[0] not in (4, 10)], "page_id long, url string, html string, component int")).collect()}
    assert apart[2] == apart[3] == apart[9] == "block"
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- pipeline ----


def test_pipeline_stage_by_stage(spark, documents, library):
    before, n = documents, []
    for name, stage in corpus_pipeline.STAGES:
        rows = before.collect()
        after = stage(spark, before, DATA)
        out = after.collect()
        n.append(len(out))
        if name != "bpe":
            assert after.columns == documents.columns
        ids = [r.doc_id for r in rows]
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            kept = {r.doc_id for r in out}
            assert np.mean([(i in kept) == bool(labels[i]) for i in ids if i in labels]) >= 0.97
        elif name == "near_dedup":
            _, label = components_by_force([r.text for r in rows], 5, 80)
            groups = defaultdict(list)
            for i, c in zip(ids, label, strict=True):
                groups[c].append(i)
            assert sorted(r.doc_id for r in out) == sorted(min(g) for g in groups.values())
        elif name == "personal_data":
            assert not [r for r in out if patterns(r.text)] and all(r.n_chars == len(r.text) for r in out)
            same = {r.doc_id: r.text for r in rows if not patterns(r.text)}
            assert np.mean([same[r.doc_id] == r.text for r in out if r.doc_id in same]) >= 0.99
        elif name == "mixing":
            assert {r.doc_id for r in out} <= set(ids) and max([r.doc_id for r in out].count(i) for i in ids) <= 3
        else:
            texts = {r.doc_id: r.text for r in rows}
            assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in out)
        before = after
    assert all(n)
