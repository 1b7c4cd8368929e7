"""Importance resampling, packing and ranked search against brute force, on small fixtures with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from test_corpus import ODD, UPPER, docs
from tidemark.llm import bpe_batch, importance, lexical, packing, queries
from tidemark.llm.packing import Capacity
from tidemark.llm.terms import terms

DATA = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
MORE = [*ODD, "x" * 300 + " tail", "é" * 200 + " über " + "中文" * 90, "a b c d e f g h i j k l m n o p q r s t u v w", "A" * 64 + " " + "b" * 65 + "-" + "c" * 64, "the cat sat on the mat " * 9, "The Cat sat on the MAT " * 9, "<|endoftext|> it's " * 40]
MORE_IDS = [*range(len(MORE) - 2), 3, None]


def features(text):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
    return found, found + [f"{a} {b}" for a, b in zip(found, found[1:])]


# ---- importance resampling ----


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "é", "中", " ", " ", "-", "0", "`", "{", "[", "\x7f", "ab" * 40, "\n"]), max_size=30).map("".join), min_size=1, max_size=5))
def test_buckets_are_checksums(texts):
    data = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    buckets, row, n_words = importance.feature_buckets(np.frombuffer(data, np.uint8), offsets)
    for k, text in enumerate(texts):
        found, all_features = features(text)
        assert n_words[k] == len(found)
        assert sorted(buckets[row == k]) == sorted(zlib.crc32(f.encode()) % 10000 for f in all_features)


def resampled_by_force(texts, ids, target, percent, least):
    s, t = (Counter(zlib.crc32(f.encode()) % 10000 for x in some for f in features(x)[1]) for some in (texts, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for k, (i, x) in enumerate(zip(ids, texts, strict=True)):
        found, f = features(x)
        weight = sum(gain(zlib.crc32(y.encode()) % 10000) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([k, i, len(found), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[5], r[1] is not None, r[1]))
    rank = {r[0]: p for p, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((i, n, w, score, rank.get(k)) for k, i, _, n, w, score in rows)


@pytest.mark.parametrize(("percent", "least"), [(25, 20), (100, 1), (0, 1), (60, 2)])
def test_resampling_by_force(spark, percent, least):
    got = importance.resample(docs(spark, MORE, MORE_IDS), docs(spark, ["the cat", None, "the mat é"]), percent, least)
    assert Counter(map(tuple, got.collect())) == resampled_by_force(MORE, MORE_IDS, ["the cat", None, "the mat é"], percent, least)


def test_resampling_of_nothing_and_of_copies(spark):
    assert importance.resample(docs(spark, ["x"]).limit(0), docs(spark, ["a"])).count() == 0
    texts = ["to be or not to be that is the question " * 3] * 300 + ["word"] * 3
    got = importance.resample(docs(spark, texts, [9] * 300 + [1, 2, 3]).repartition(7), docs(spark, [None]).limit(0)).collect()
    assert sorted(r.rank for r in got if r.rank) == [*range(1, 76)] and {r.doc_id for r in got if r.rank} == {9}


# ---- packing ----


def best_fit_by_force(lengths, capacity, by):
    """One piece at a time into the sequence that fits best."""
    bins: list[np.ndarray] = []
    for length in sorted(lengths, reverse=True):
        need = capacity.needs(length)
        badness = packing.fits(np.array(bins).reshape(-1, 3), need, capacity, by)
        k = int(np.argmin(badness)) if len(bins) else 0
        if bins and np.isfinite(badness[k]):
            bins[k] = bins[k] - need
        else:
            bins.append(capacity.whole - need)
    return bins


def laid_out(steps, counts):
    """Sequence -> its (offset, length) of a plan."""
    used = defaultdict(list)
    for length, n in counts.items():
        rows = steps[steps[:, 0] == length]
        for (_, first, sequence, each, offset), last in zip(rows, [*rows[1:, 1], n], strict=True):
            for k in range(last - first):
                used[sequence + k // each].append((offset + k % each * length, length))
    return used


def check_sequences(used, capacity):
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(held) <= capacity.documents and sum(n * n for _, n in held) <= capacity.attention


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([Capacity(40, 40, 1600), Capacity(40, 4, 1600), Capacity(60, 6, 1700), Capacity(50, 50, 1600, (1.0, 0.0, 0.0))]), st.sampled_from(["dot", "norm"]))
def test_a_plan_packs_like_one_piece_at_a_time(lengths, capacity, by):
    counts = Counter(lengths)
    used = laid_out(packing.plan(counts, capacity, by), counts)
    check_sequences(used, capacity)
    assert Counter(n for held in used.values() for _, n in held) == counts
    assert sorted(used) == [*range(len(used))]
    assert len(used) == len(best_fit_by_force(lengths, capacity, by))


def test_a_plan_of_many_pieces_is_short():
    rng = np.random.default_rng(5)
    counts = Counter(np.minimum(4096, 1 + rng.geometric(1 / 700, 3_000_000)).tolist())
    steps = packing.plan(counts)
    assert len(steps) < 50_000
    least = -(-sum(n * length for length, n in counts.items()) // 4096)
    # Of the last kind of sequence, one row says how many there are: the highest number any piece gets.
    ends = {}
    for (length, first, sequence, each, _), after in zip(steps, [*steps[1:], [0] * 5], strict=True):
        last = after[1] if after[0] == length else counts[length]
        ends[sequence] = max(ends.get(sequence, 0), sequence + -(-(last - first) // each))
    assert max(ends.values()) <= 1.001 * least


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["'", "s", "re", "'ll", "<|endoftext|>", "<|start", "Σ", "É", " ", "\n", "\x1c", "\x85", "A", "9", "#!", "İ", "ß", "中", "Ƛ", "the", "qz" * 40, "a" * 90, "!" * 70]), max_size=12).map("".join), max_size=6))
def test_ids_of_batches_are_the_librarys(library, texts):
    got = bpe_batch.batch_encoder(VOCAB).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_the_table_of_stretches_starts_anew(library):
    encoder = bpe_batch.BatchBpe(bpe_batch.encoder(VOCAB), 20_000)
    for low in range(0, 2000, 100):
        texts = [f"word{k} again{k % 7} {k}" for k in range(low, low + 100)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.kept) < 600


def check_packed(rows, texts, ids, library, capacity):
    want = Counter()
    for i, text in zip(ids, texts, strict=True):
        tokens = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(tokens), capacity.longest)):
            cut = tokens[at : at + capacity.longest]
            want[i, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    check_sequences(used, capacity)
    assert len(used) == len(best_fit_by_force([r.length for r in rows], capacity, "dot"))


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(64, 3, 64 * 64)])
def test_packing_of_odd_rows(spark, library, capacity):
    rows = packing.pack_documents(docs(spark, MORE, MORE_IDS).repartition(3), VOCAB, capacity).collect()
    check_packed(rows, MORE, MORE_IDS, library, capacity)
    assert packing.pack_documents(docs(spark, ["x"]).limit(0), VOCAB, capacity).count() == 0


def test_packing_query(spark, library):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    check_packed(queries.op12_packing(spark, DATA).collect(), [r.text for r in table], [r.doc_id for r in table], library, Capacity())


def test_sequences_hold_their_pieces_ids(spark, library):
    texts, capacity = [*MORE[:-2], "last one"], Capacity(64, 3, 64 * 64)
    got = packing.packed_sequences(docs(spark, texts), VOCAB, capacity).collect()
    found = defaultdict(list)
    for r in got:
        assert len(r.ids) <= 64 and len(r.doc_ids) == len(r.edges) <= 3
        for i, a, b in zip(r.doc_ids, r.edges, [*r.edges[1:], len(r.ids)], strict=True):
            found[i].append(r.ids[a:b])
    for i, text in enumerate(texts):
        tokens = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert sorted(found[i]) == sorted(tokens[k : k + 64] for k in range(0, len(tokens), 64))


# ---- ranked search ----


def searched_by_force(texts, ids, items, item_ids, k):
    words = [[t.decode() for t in terms((x or "").encode())] for x in texts]
    assert words == [re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (x or "").translate(UPPER)) for x in texts]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item_id, item in zip(item_ids, items, strict=True):
        asked, found = terms((item or "").encode()), []
        for row, (i, w) in enumerate(zip(ids, words, strict=True)):
            tf = Counter(w)
            m = 25 + 75 * len(w) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for x in asked if tf[t := x.decode()])
            if score > 0:
                found.append((-score, i is not None, i, row))
        out += [(item_id, rank, i, -score) for rank, (score, _, i, _) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ITEMS, ITEM_IDS = ["the cat", None, "", "one words MAT the the", "nothing known", "the cat", "éàü xx " + "x" * 300], [5, 6, 7, 8, 9, 5, None]


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("shard", [2, 4096])
def test_search_by_force(spark, monkeypatch, sent, shard):
    monkeypatch.setattr(lexical, "SENT_ROWS", 1 << 20 if sent else 0)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    items = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ITEM_IDS, ITEMS, strict=True)], "item_id long, text string, row int, term string")
    got = lexical.ranked_search(docs(spark, MORE, MORE_IDS).repartition(3), items, 4)
    assert Counter(map(tuple, got.collect())) == searched_by_force(MORE, MORE_IDS, ITEMS, ITEM_IDS, 4)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    assert lexical.ranked_search(docs(spark, ["one"]).limit(0), items).count() == 0
    assert lexical.ranked_search(docs(spark, ["one", "two"]), items.limit(0)).count() == 0
    assert lexical.ranked_search(docs(spark, [None, ""]), items).count() == 0


def test_an_index_of_all_terms(spark):
    held = lexical.postings(docs(spark, MORE).coalesce(1)).toPandas()
    shard = held[held.term.isna()]
    assert shard.shard_docs.sum() == sum(bool(terms((t or "").encode())) for t in MORE)
    want = Counter((i, t.decode(), n) for i, x in enumerate(MORE) for t, n in Counter(terms((x or "").encode())).items())
    got = Counter((i, r.term, n) for r in held[held.term.notna()].itertuples() for i, n in zip(r.doc_id, r.tf, strict=True))
    assert got == want
