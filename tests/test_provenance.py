"""Copy chains, log rules, connected material and parents-first orders, by hand."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import provenance


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(ids):
    if len(ids) == 1:
        return sha(str(ids[0]))
    k = 1
    while 2 * k < len(ids):
        k *= 2
    return sha(merkle(ids[:k]) + merkle(ids[k:]))


def walked(links):
    out = {}
    for i in links:
        chain, at, status = [i], links[i], "ok"
        while at is not None:
            if at not in links:
                status = "missing"
                break
            if len(chain) > len(links):
                status = "cycle"
                break
            chain.append(at)
            at = links[at]
        out[i] = (None, None, None, "cycle") if status == "cycle" else (len(chain) - 1, chain[-1], merkle(chain), status)
    return out


def test_chains_are_the_walk(spark):
    rng = np.random.default_rng(3)
    links = {i: int(rng.integers(0, i)) if i and rng.random() < 0.9 else None for i in range(300)}
    links |= {400: 999, 401: 400, 402: 401, 500: 501, 501: 502, 502: 500, 503: 501, 600: 600}
    rows = [(i, s) for i, s in links.items()] + [(7, links[7]), (None, 3)]
    got = {r.id: (r.chain_length, r.end, r.digest, r.status) for r in provenance.chains(spark.createDataFrame(rows, "id long, source long").repartition(3)).collect()}
    assert got == walked(links)


def test_a_chain_of_ten_thousand(spark):
    """As many rounds as the length has binary digits, and one end that all rows point towards."""
    n = 10_000
    df = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS source")
    got = provenance.chains(df)
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"ok": n}
    rows = {r.id: r for r in got.where("id in (0, 1, 4097, 9999)").collect()}
    for i, r in rows.items():
        assert (r.chain_length, r.end, r.digest) == (i, 0, merkle([*range(i, -1, -1)]))


def test_no_chains(spark):
    assert provenance.chains(spark.createDataFrame([], "id long, source long")).count() == 0


EVENTS = "seq long, kind string, id string, source string, token string, slot string"


def test_rules_of_copies(spark):
    rows = [
        (1, "edge", "a", None, "t1", "left"), (2, "edge", "b", "a", "t1", "left"), (3, "edge", "c", "b", "t1", "right"),
        (4, "edge", "d", "z", "t9", "left"), (5, "edge", "a", None, "t2", "left"), (6, "node", "a", None, "t1", None),
        (7, "node", "n", "b", "t1", "left"), (8, "edge", "e", "late", "t5", None), (9, "edge", "late", None, "t5", None),
        (10, "edge", None, None, "t6", None), (11, "edge", "f", "outside", "t7", None), (12, "edge", "outside", None, "t8", None),
        (13, "edge", "g", "g", "t10", None), (14, "edge", "h", None, None, None), (15, "edge", "i", None, None, None), (16, "edge", "k", "a", "t2", "left"),
    ]
    want = {
        (3, "altered_copy"), (4, "absent_source"), (5, "repeated_id"), (6, "reused_token"), (7, "absent_source"), (8, "absent_source"),
        (10, "no_id"), (12, "repeated_id"), (13, "absent_source"), (16, "altered_copy"),
    }
    df = spark.createDataFrame(rows, EVENTS)
    got = provenance.copy_violations(df, ["slot"], spark.createDataFrame([("outside",), (None,), ("outside",)], "id string")).collect()
    assert {(r.seq, r.rule) for r in got} == want and len(got) == len(want)
    without = {(r.seq, r.rule) for r in provenance.copy_violations(df, ["slot"]).collect()}
    assert without == want - {(12, "repeated_id")} | {(11, "absent_source")}
    assert provenance.copy_violations(df.limit(0), ["slot"]).count() == 0


def _broken(rows, trusted):
    """The rules of copies, event by event; places in the log are unique."""
    held, minted, out = {}, {}, []
    for seq, kind, i, source, token, slot in sorted(rows):
        old = held.get((kind, source))
        if i is None:
            out.append((seq, "no_id"))
        if i is not None and ((kind, i) in held or i in trusted):
            out.append((seq, "repeated_id"))
        if source is not None and old is None and source not in trusted:
            out.append((seq, "absent_source"))
        if source is not None and old is not None and old != (token, slot):
            out.append((seq, "altered_copy"))
        if source is None and token is not None and token in minted:
            out.append((seq, "reused_token"))
        if i is not None:
            held.setdefault((kind, i), (token, slot))
        if source is None and token is not None:
            minted.setdefault(token, seq)
    return sorted(out)


@pytest.mark.parametrize(("names", "most"), [(12, 1 << 21), (400, 1 << 21), (400, 0)])
def test_rules_hold_for_logs_of_any_kind(spark, monkeypatch, names, most):
    """Logs in which most ids meet another, and in which few do; with and without a broadcast of these."""
    monkeypatch.setattr(provenance, "MET", most)
    rng = random.Random(names)
    pick = lambda n, none=0.1: None if rng.random() < none else f"i{rng.randrange(n)}"
    rows = []
    for seq in rng.sample(range(1000), 300):
        i = pick(names)
        rows.append((seq, rng.choice(["edge", "node"]), i, rng.choice([None, i, pick(names)]), rng.choice([None, "t1", f"t{rng.randrange(60)}"]), rng.choice([None, "left"])))
    trusted = [f"i{k}" for k in range(0, 2 * names, 9)]
    df, boundary = spark.createDataFrame(rows, EVENTS), spark.createDataFrame([(t,) for t in trusted], "id string")
    for known, table in ((set(trusted), boundary), (set(), None)):
        got = provenance.copy_violations(df, ["slot"], table).collect()
        assert sorted((r.seq, r.rule) for r in got) == _broken(rows, known)


def test_whole_events_are_shuffled_only_where_ids_meet(spark, monkeypatch):
    """In a log without repeated ids or sources in it, only hashes of ids and what is minted go through a shuffle."""
    rows = [(i, "edge", f"i{i}", f"i{i}" if i % 3 else None, f"t{i}", None) for i in range(300)]
    linked, found = [], provenance._link_violations
    monkeypatch.setattr(provenance, "_link_violations", lambda e, *a: linked.append(e.count()) or found(e, *a))
    df = spark.createDataFrame([*rows, (900, "edge", "new", "i7", "t7", None)], EVENTS)
    got = provenance.copy_violations(df, ["slot"]).collect()
    late = spark.createDataFrame([(None, "edge", "i1", None, None, None)], EVENTS)
    assert [r.rule for r in provenance.copy_violations(late, ["slot"], spark.createDataFrame([("i1",)], "id string")).collect()] == ["repeated_id"]
    assert linked == [2, 1] and sorted((r.seq, r.rule) for r in got) == [(i, "absent_source") for i in range(300) if i % 3]


NODES = "seq long, id string, source string, token string, left_edge string, left_record string, right_edge string, right_record string, witness string, witness_update long, witness_individual string"
EDGES = "seq long, id string, token string, parent_token string, child_token string, slot string"


@pytest.fixture(scope="module")
def log(spark):
    """Two leaves under a split, a copy of all three, and nodes that break the rules."""
    leaf = lambda seq, i, token, source=None, w=(None, None, None): (seq, i, source, token, None, None, None, None, *w)
    nodes = [
        leaf(1, "l", "tl"), leaf(2, "r", "tr"), (5, "s", None, "ts", "el", "l", "er", "r", None, None, None),
        leaf(7, "l2", "tl", "l"), leaf(8, "r2", "tr", "r"), (11, "s2", "s", "ts", "el2", "l2", "er2", "r2", "s", 3, "x"),
        (12, "s3", "s", "ts", "el2", "l2", "er2", "r2", "s", 4, "x"), (13, "s4", "s", "ts", "er2", "l2", "el2", "r2", None, None, None),
        (14, "s5", None, "tz", "el", "l", "er", "gone", "s", 3, "x"), leaf(15, "odd", "tl", "l", ("s", 3, "x")), (16, "loop", "s", "ts", "el", "loop", "er", "r", None, None, None),
        leaf(17, "w", "tl", "l", ("l", 1, "y")),
    ]
    edges = [(3, "el", "te", "ts", "tl", "left"), (4, "er", "tf", "ts", "tr", "right"), (9, "el2", "te", "ts", "tl", "left"), (10, "er2", "tf", "ts", "tr", "right")]
    witnesses = [(6, "s", 3, "x"), (18, "l", 1, "y"), (19, "s", 3, "x"), (20, "nowhere", 1, "x")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(witnesses, "seq long, record string, update long, individual string")


def test_material_is_what_is_connected(log):
    nodes, edges, _ = log
    leaf = lambda t: sha(f"leaf|{t}")
    split = sha("|".join(["split", "ts", "te", leaf("tl"), "tf", leaf("tr")]))
    got = {r.id: r.digest for r in provenance.material(nodes, edges).collect()}
    assert got["s"] == got["s2"] == got["s3"] == split and got["l2"] == got["odd"] == leaf("tl")
    assert got["s4"] != split and "s5" not in got and "loop" not in got


def test_rules_of_structure(log):
    got = {(r.seq, r.id, r.rule) for r in provenance.structure_violations(*log).collect()}
    assert got == {
        (12, "s3", "forged_witness"), (13, "s4", "bad_left"), (13, "s4", "bad_right"), (14, "s5", "bad_left"), (14, "s5", "bad_right"), (14, "s5", "new_with_witness"),
        (14, "s5", "forged_witness"), (15, "odd", "forged_witness"), (16, "loop", "bad_left"), (17, "w", "forged_witness"), (19, "s", "repeated_witness"), (20, "nowhere", "absent_record"),
    }


def ordered_by_force(nodes, edges):
    level, waiting = {}, set(nodes)
    parents = {n: {p for c, p in edges if c == n and p in waiting} for n in nodes}
    k = 0
    while free := sorted(n for n in waiting if all(p in level for p in parents[n])):
        level |= dict.fromkeys(free, k)
        waiting -= set(free)
        k += 1
    rest = set(waiting)
    while free := {n for n in waiting if not any(c in waiting and n == p for c, p in edges)}:
        waiting -= free
    order = {n: i for i, n in enumerate(sorted(level, key=lambda n: (level[n], n)), 1)}
    return {n: (level[n], order[n], "ordered") if n in level else (None, None, "cycle" if n in waiting else "behind") for n in {*level, *rest}}


@pytest.mark.parametrize("seed", [1, 2])
def test_parents_come_first(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = [*range(120)]
    edges = [(int(c), int(p)) for c, p in rng.integers(0, 130, (110, 2)) if c != p] + [(100, 101), (101, 100), (102, 101), (103, 102), (5, 5), (60, 59), (60, 59)] + [(k + 1, k) for k in range(20, 45)]
    got = provenance.parents_first(spark.createDataFrame([(n,) for n in [*nodes, 3, None]], "node long"), spark.createDataFrame(edges, "child long, parent long")).collect()
    assert len(got) == len(nodes)
    assert {r.node: (r.level, r.place, r.status) for r in got} == ordered_by_force(nodes, edges)
    assert provenance.parents_first(spark.createDataFrame([], "node long"), spark.createDataFrame([], "child long, parent long")).count() == 0


def test_rules_of_forks(spark):
    rows = [("p", None, None, [500, 2000], "s1", 1), ("a", "p", 500, None, "s1", 1), ("b", "p", 501, None, "s1", 1), ("c", "q", 500, None, "s1", 1), ("d", "a", 500, None, "s1", 1), ("e", "p", 2000, None, "s2", 1), ("f", "p", 2000, None, "s1", 1), ("f", "p", 500, None, "s1", 1)]
    df = spark.createDataFrame(rows, "id string, parent_id string, start int, checkpoints array<int>, scenario string, realisation int")
    got = {(r.id, r.rule) for r in provenance.fork_violations(df, ["scenario", "realisation"]).collect()}
    assert got == {("b", "no_checkpoint"), ("c", "absent_parent"), ("d", "nested"), ("d", "no_checkpoint"), ("e", "other_stream"), ("f", "repeated")}


def test_events_without_a_source_do_not_meet_in_one_task(spark):
    """Half of a log may be new material; its rows are dealt like the others, and meet nothing."""
    log = spark.range(4000).selectExpr("id as seq", "'node' as kind", "cast(id as string) as id", "cast(null as string) as source", "concat('t', id) as token")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ids = spark.createDataFrame([("0",), ("5",)], "key string")
        met = provenance._looked_up(log, ids, "source", "key")
        sizes = met.groupBy(F.spark_partition_id()).count().collect()
        assert met.where("key is not null").count() == 0 and sum(r["count"] for r in sizes) == 4000
        assert max(r["count"] for r in sizes) < 2000
        assert provenance._looked_up(log, ids, "id", "key").where("key is not null").count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
