"""Provenance: what was copied from where, whether a log holds together, and orders in which parents come first.

A log has one row for each event: seq (its place), kind, id, source (the id it was copied from, null for new material) and
token (who minted it), and what else a copy must keep. An id that occurs again changes nothing: its first event holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import ranked
from tidemark.operators.stored import store

#: Hashes of ids that are broadcast at most.
MET = 1 << 21


def chains(links: DataFrame, node: str = "id", source: str = "source") -> DataFrame:
    """Certificates of copy chains by pointer doubling: (id, chain_length, end, digest, status).

    A node's chain is itself, its source, that one's source, and on. chain_length counts its links; `end` is its last
    node. `digest` is a Merkle tree over the ids' SHA-256, in hex: of one node its hash, of more the hash of the digests of
    the first 2^k and of the rest, 2^k being the largest power of two below their number. So two chains of the same ids
    have the same digest, and doubling makes it on the way: in each round a node takes over what its pointer's node has
    covered, and as many rounds as the longest chain has binary digits are enough.

    status: ok; missing (the last node's source is not in the table); cycle (no end, and no length or digest). Rows
    without an id are passed over; of repeated ids the smallest source holds.
    """
    links = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(source).alias("next"))
    there = links.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    own = F.sha2(F.col("id").cast("string"), 256)
    state = links.join(there, "next", "left")
    live = F.col("there").isNotNull()
    state = store(state.select("id", F.when(live, F.col("next")).alias("next"), F.lit(0).cast("long").alias("chain_length"), F.col("id").alias("end"), own.alias("digest"), (F.col("next").isNotNull() & ~live).alias("missing")))
    count = state.count()
    done, active = state.where("next is null"), state.where("next is not null")
    rounds = count.bit_length() + 1
    while rounds and active.limit(1).count():
        # Whatever a pointer leads to is in the table: finished, or covering as much as the pointing node.
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("chain_length").alias("more"), F.col("end").alias("new_end"), F.col("digest").alias("rest"), F.col("missing").alias("lost"))
        joined = active.drop("end", "missing").join(ahead, "next")
        active = joined.select("id", F.col("further").alias("next"), (F.col("chain_length") + F.col("more") + 1).alias("chain_length"), F.col("new_end").alias("end"), F.sha2(F.concat("digest", "rest"), 256).alias("digest"), F.col("lost").alias("missing"))
        state = store(done.unionByName(active))
        done, active = state.where("next is null"), state.where("next is not null")
        rounds -= 1
    ended = F.col("next").isNull()
    status = F.when(~ended, "cycle").when(F.col("missing"), "missing").otherwise("ok")
    return state.select("id", *(F.when(ended, F.col(c)).alias(c) for c in ("chain_length", "end", "digest")), status.alias("status"))


def _held(events: DataFrame, *keep: str) -> DataFrame:
    """The first event of each kind and id: what a copy may refer to. Aggregated before the shuffle, so no id is hot."""
    first = F.min(F.struct("seq", *keep)).alias("first")
    return events.where("id is not null").groupBy(F.col("kind").alias("held_kind"), F.col("id").alias("held_id")).agg(first)


def _looked_up(events: DataFrame, table: DataFrame, by: str, key: str, also: Column | None = None) -> DataFrame:
    """`events` left joined to `table` where `by` equals its `key`. Events without one meet nothing and are dealt by seq, not to one task."""
    asked = events.withColumn("asks", F.col(by).isNotNull()).withColumn("dealt_by", F.coalesce(F.col(by).cast("string"), F.col("seq").cast("string")))
    table = table.withColumn("answers", F.lit(True)).withColumn("its_key", F.col(key).cast("string"))
    on = (F.col("asks") == F.col("answers")) & (F.col("dealt_by") == F.col("its_key"))
    return asked.join(table, on if also is None else on & also, "left").drop("asks", "answers", "dealt_by", "its_key")


def _rules(df: DataFrame, rules: dict, *keys: str) -> DataFrame:
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(found).alias("rule"))


def _key(c: str) -> Column:
    return F.xxhash64(F.col(c).cast("string"))


def _met(events: DataFrame, trusted: DataFrame | None) -> DataFrame:
    """(key): hashes of the ids that an event refers to, as its own or as its source, after the first event that has it, or that are trusted too.

    Only hashes and numbers are shuffled. Ids that share a hash, or an id with several kinds, may be among them for nothing.
    """
    none = F.lit(None).cast(events.schema["seq"].dataType)
    parts = [  # by: 1 for events, 2 for what is trusted
        events.where("id is not null").select(_key("id").alias("key"), F.col("seq").alias("held"), F.col("seq").alias("used"), F.lit(1).alias("by")),
        events.where("source is not null").select(_key("source").alias("key"), none.alias("held"), F.col("seq").alias("used"), F.lit(1).alias("by")),
    ]
    if trusted is not None:
        parts.append(trusted.select(_key("id").alias("key"), none.alias("held"), none.alias("used"), F.lit(2).alias("by")))
    seen = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min("held").alias("held"), F.max("used").alias("used"), F.bit_or("by").alias("by"))
    return seen.where("used > held or by = 3").select("key")


def copy_violations(events: DataFrame, same: list[str], boundary: DataFrame | None = None) -> DataFrame:
    """(seq, kind, id, rule) of nodes and edges whose links do not hold; nothing for a closed log.

    Rules: no_id; repeated_id (not the first event of its kind and id, or an id of the boundary); absent_source (no earlier
    event of the kind has the source as id, nor does the trusted `boundary`, a table with `id`); altered_copy (the source's
    event differs in `token` or in a column of `same`; sources in the boundary are not compared); reused_token (new material
    with a token that an earlier event has minted). Places in the log are by seq; of events at one seq none is earlier.

    Whole events are shuffled only if their id or source is among those that `_met` finds; of the others a source is
    absent and an id the first. Where these are more than MET, all are shuffled.
    """
    trusted = None if boundary is None else boundary.select("id").where("id is not null")
    met, apart = store(_met(events, trusted)), []
    linked = events
    if met.count() <= MET:
        mark = lambda c: (F.broadcast(met.withColumnRenamed("key", f"{c}_met")), _key(c) == F.col(f"{c}_met"), "left")
        marked = events.join(*mark("id")).join(*mark("source"))
        alone = F.col("id_met").isNull() & F.col("source_met").isNull()
        apart.append(_rules(marked.where(alone), {"no_id": F.col("id").isNull(), "absent_source": F.col("source").isNotNull()}, "seq", "kind", "id"))
        linked = store(marked.where(~alone).select(*events.columns))
        if trusted is not None:
            trusted = trusted.join(F.broadcast(met), _key("id") == F.col("key"), "left_semi")
    new = events.where("source is null and token is not null").select("seq", "kind", "id", "token")
    minted = new.groupBy("token").agg(F.min("seq").alias("minted_at"))
    reused = new.join(minted, "token").where("minted_at < seq").select("seq", "kind", "id", F.lit("reused_token").alias("rule"))
    return reduce(DataFrame.unionByName, [_link_violations(linked, same, trusted), *apart, reused])


def _link_violations(events: DataFrame, same: list[str], trusted: DataFrame | None) -> DataFrame:
    """Those of `copy_violations` that an event's id and source break."""
    kept = ["token", *same]
    held = _held(events, *kept)
    own = held.select("held_kind", "held_id", F.col("first.seq").alias("first_seq"))
    e = _looked_up(events, own, "id", "held_id", F.col("kind") == F.col("held_kind")).drop("held_kind", "held_id")
    sources = held.select("held_kind", "held_id", F.col("first").alias("old"))
    e = _looked_up(e, sources, "source", "held_id", F.col("kind") == F.col("held_kind")).drop("held_kind", "held_id")
    trusted_source = trusted_id = F.lit(False)
    if trusted is not None:
        ids = trusted.distinct()
        e = _looked_up(e, ids.select(F.col("id").alias("trusted_source")), "source", "trusted_source")
        e = _looked_up(e, ids.select(F.col("id").alias("trusted_id")), "id", "trusted_id")
        trusted_source, trusted_id = F.col("trusted_source").isNotNull(), F.col("trusted_id").isNotNull()
    copied = F.col("source").isNotNull()
    earlier = F.coalesce(F.col("old.seq") < F.col("seq"), F.lit(False))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col("old")[c]) for c in kept))
    rules = {
        "no_id": F.col("id").isNull(),
        "repeated_id": (F.col("seq") > F.col("first_seq")) | trusted_id,
        "absent_source": copied & ~earlier & ~trusted_source,
        "altered_copy": copied & earlier & differs,
    }
    return _rules(e, rules, "seq", "kind", "id")


def material(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, digest) of the connected material under each node: the tokens of its subtree and of the edges in it.

    nodes: id, token, and for splits left_edge, left_record, right_edge, right_record. A node's digest is SHA-256 of its
    token and, for splits, of both edges' tokens and both subtrees' digests. Each round makes those whose children are
    known, so there are as many rounds as trees are deep. Nodes over missing records or on cycles have no digest.
    """
    tokens = edges.groupBy(F.col("id").alias("edge")).agg(F.min_by("token", "seq").alias("edge_token"))
    nodes = nodes.where("id is not null").groupBy("id").agg(F.min(F.struct("seq", "token", "left_edge", "left_record", "right_edge", "right_record")).alias("n")).select("id", "n.*")
    for side in ("left", "right"):
        nodes = nodes.join(tokens.select(F.col("edge").alias(f"{side}_edge"), F.col("edge_token").alias(f"{side}_token")), f"{side}_edge", "left")
    split = F.col("left_record").isNotNull() | F.col("right_record").isNotNull()
    known = store(nodes.where(~split).select("id", F.sha2(F.concat(F.lit("leaf|"), "token"), 256).alias("digest")).where("digest is not null"))
    waiting = store(nodes.where(split).select("id", "token", "left_token", "left_record", "right_token", "right_record"))
    found = [known]
    while True:
        # A subtree that became known in the last round is new for its parents only; the others were looked up before.
        side = lambda s: known.select(F.col("id").alias(f"{s}_record"), F.col("digest").alias(f"{s}_digest"))  # noqa: B023, E731
        made = waiting.join(side("left"), "left_record").join(side("right"), "right_record")
        text = F.concat_ws("|", F.lit("split"), "token", "left_token", "left_digest", "right_token", "right_digest")
        whole = F.col("token").isNotNull() & F.col("left_token").isNotNull() & F.col("right_token").isNotNull()
        made = store(made.where(whole).select("id", F.sha2(text, 256).alias("digest")))
        if not made.limit(1).count():
            return known
        found.append(made)
        known = store(reduce(DataFrame.unionByName, found))
        found = [known]
        waiting = store(waiting.join(made, "id", "left_anti"))


def structure_violations(nodes: DataFrame, edges: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(seq, id, rule) of nodes that are not connected as they say, and of witnesses that don't hold.

    nodes: seq, id, source, token, the four columns of `material`, and witness (the record it claims to be a connected
    copy of), witness_update, witness_individual. edges: seq, id, token, parent_token, child_token, slot. witnesses: seq,
    record, update, individual.

    Rules of nodes: bad_left, bad_right (no earlier edge and record of these ids that join the node's token to the
    record's, on that side); new_with_witness (new material that claims one); forged_witness (no earlier witness of that
    record with the same update and individual, or other material under it). Of witnesses: absent_record, repeated_witness.
    """
    edge = edges.where("id is not null").groupBy(F.col("id").alias("edge")).agg(F.min(F.struct("seq", "parent_token", "child_token", "slot")).alias("e"))
    record = nodes.where("id is not null").groupBy(F.col("id").alias("record")).agg(F.min(F.struct("seq", "token")).alias("r"))
    out = []
    for side in ("left", "right"):
        asked = nodes.where("left_record is not null or right_record is not null").select("seq", "id", "token", F.col(f"{side}_edge").alias("edge"), F.col(f"{side}_record").alias("record"))
        asked = asked.join(edge, "edge", "left").join(record, "record", "left")
        joins = (F.col("e.seq") < F.col("seq")) & (F.col("r.seq") < F.col("seq")) & (F.col("e.parent_token") == F.col("token")) & (F.col("e.child_token") == F.col("r.token")) & (F.col("e.slot") == side)
        out.append(asked.where(~F.coalesce(joins, F.lit(False))).select("seq", "id", F.lit(f"bad_{side}").alias("rule")))
    claims = nodes.where("witness is not null")
    out.append(claims.where("source is null").select("seq", "id", F.lit("new_with_witness").alias("rule")))
    held = witnesses.where("record is not null").groupBy(F.col("record").alias("witness")).agg(F.min(F.struct("seq", "update", "individual")).alias("w"))
    digests = store(material(nodes, edges))
    claims = claims.join(held, "witness", "left").join(digests.select("id", F.col("digest").alias("own")), "id", "left").join(digests.select(F.col("id").alias("witness"), F.col("digest").alias("its")), "witness", "left")
    holds = (F.col("w.seq") < F.col("seq")) & F.col("w.update").eqNullSafe(F.col("witness_update")) & F.col("w.individual").eqNullSafe(F.col("witness_individual")) & (F.col("own") == F.col("its"))
    out.append(claims.where(~F.coalesce(holds, F.lit(False))).select("seq", "id", F.lit("forged_witness").alias("rule")))
    seen = witnesses.join(record, "record", "left").join(held.select(F.col("witness").alias("record"), F.col("w.seq").alias("first")), "record", "left")
    rules = {"absent_record": ~F.coalesce(F.col("r.seq") < F.col("seq"), F.lit(False)), "repeated_witness": F.col("seq") > F.col("first")}
    out.append(_rules(seen.withColumn("id", F.col("record")), rules, "seq", "id"))
    return reduce(DataFrame.unionByName, out)


def parents_first(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """(node, level, place, status): an order of all nodes in which parents come first, and what has none.

    nodes: node; edge: (child, parent), of nodes. level is the longest way up; place counts from 1 by level and node.
    Each round frees the nodes whose parents are all free; it looks at the children of the last round's nodes only, and
    at those that still wait for another parent. Nodes that are never freed have no level and place, and status `cycle`
    (on a cycle, or between two) or `behind` (below one); the others are `ordered`. Parents that are no nodes don't count.
    """
    nodes = store(nodes.select("node").where("node is not null").distinct())
    known = nodes.select(F.col("node").alias("child")), nodes.select(F.col("node").alias("parent"))
    edge = store(edge.select("child", "parent").distinct().join(known[0], "child", "left_semi").join(known[1], "parent", "left_semi"))
    levels = _peel(nodes, edge, "child", "parent")
    left = store(nodes.join(levels.select("node"), "node", "left_anti"))
    among = edge.join(left.select(F.col("node").alias("child")), "child", "left_semi").join(left.select(F.col("node").alias("parent")), "parent", "left_semi")
    behind = _peel(left, store(among), "parent", "child").select("node", F.lit("behind").alias("status"))
    placed = ranked(levels, F.col("level"), F.col("node")).withColumn("status", F.lit("ordered"))
    rest = left.join(behind, "node", "left").select("node", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place"), F.coalesce("status", F.lit("cycle")).alias("status"))
    return placed.unionByName(rest)


def _peel(nodes: DataFrame, edge: DataFrame, waits: str, on: str) -> DataFrame:
    """(node, level) of the nodes that are freed when each waits for all it is joined to by `edge`."""
    need = store(edge.groupBy(F.col(waits).alias("node")).agg(F.count("*").alias("need")))
    front = store(nodes.join(need, "node", "left_anti").select("node"))
    found, partly, level = [], None, 0
    while front.limit(1).count():
        found.append(front.withColumn("level", F.lit(level)))
        if len(found) > 16:  # keeps the plan short
            found = [store(reduce(DataFrame.unionByName, found))]
        got = front.join(edge, F.col("node") == F.col(on)).groupBy(F.col(waits).alias("waiting")).agg(F.count("*").alias("got"))
        if partly is not None:
            got = got.unionByName(partly).groupBy("waiting").agg(F.sum("got").alias("got"))
        got = store(got.join(need, F.col("waiting") == F.col("node")).select("waiting", "got", "need"))
        front = got.where("got = need").select(F.col("waiting").alias("node"))
        partly = got.where("got < need").select("waiting", "got")
        level += 1
    if not found:
        return nodes.select("node", F.lit(0).alias("level")).limit(0)
    return reduce(DataFrame.unionByName, found)


def fork_violations(tasks: DataFrame, same: list[str]) -> DataFrame:
    """(id, rule) of tasks whose parent task is not as it must be.

    tasks: id, parent_id (null for parents), start, checkpoints (array, of parents), and the columns of `same`. Rules:
    repeated (an id of several tasks), absent_parent, nested (the parent has a parent), no_checkpoint (the parent doesn't
    save at the fork's start), other_stream (it differs in a column of `same`).
    """
    parent = tasks.where("id is not null").groupBy(F.col("id").alias("its_id")).agg(F.count("*").alias("copies"), F.min(F.struct("parent_id", "checkpoints", *same)).alias("p"))
    repeated = parent.where("copies > 1").select(F.col("its_id").alias("id"), F.lit("repeated").alias("rule"))
    forks = tasks.where("parent_id is not null").select("id", "parent_id", "start", *same).join(parent, F.col("parent_id") == F.col("its_id"), "left")
    there = F.col("its_id").isNotNull()
    rules = {
        "absent_parent": ~there,
        "nested": there & F.col("p.parent_id").isNotNull(),
        "no_checkpoint": there & ~F.coalesce(F.array_contains("p.checkpoints", F.col("start")), F.lit(False)),
        "other_stream": there & reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col("p")[c]) for c in same)),
    }
    return _rules(forks, rules, "id").unionByName(repeated)
