"""The prefix trie against a plain version, its levels of bands, and its edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import trie
from tallyforge.llm.common import Scratch
from tallyforge.llm.queries import op13_conversation_trie


def plain_nodes(convs):
    """{conv: [(role, text)]} to rows of the contract."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key, who in members.items():
        own = (len(who) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] += own
            leaves[key[:d]] += key not in kids
    rows = []
    for key, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(key))))
        rows.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids.get(key, [])), leaves[key], saved[key],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def rebuilt(rows):
    """The contract's splice of raw (conv, turn, role, text) rows."""
    orig = {}
    for c, t, r, x in rows:
        if c is not None:
            orig.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    orig = {c: [x[2:] for x in sorted(v)] for c, v in orig.items()}
    take = {c: zlib.crc32(str(c).encode()) % 9 for c in orig}
    return {c: orig.get(c - c % 5, [])[:take[c]] + v[take[c]:] for c, v in orig.items()}


def got(built):
    digests = trie.id_digests(built.ends, "node", "conv_id")
    rows = built.nodes.join(digests, "node", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["sha256"] or empty)
                   for r in rows), key=repr)


def tables(spark, convs):
    turns = [(c, i + 1, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)]
    return (spark.createDataFrame([(c,) for c in convs], "conv_id long"), spark.createDataFrame(turns, "conv_id long, pos long, role string, text string"))


def random_convs(seed, n=60, depth=25):
    rnd = random.Random(seed)
    out = {}
    for c in rnd.sample(range(1000), n):
        base = list(rnd.choice(list(out.values()))) if out and rnd.random() < 0.7 else []
        base = base[:rnd.randint(0, len(base))]
        out[c] = base + [(rnd.choice("ua"), rnd.choice(["", "é", "hello", "a b"])) for _ in range(rnd.randint(0, depth - min(depth, len(base))))]
    return out


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie(spark, height):
    convs = random_convs(height)
    assert got(trie.prefix_trie(*tables(spark, convs), height=height)) == plain_nodes(convs)


def test_hot_conversations(tight):
    shared = [("u", f"t{i}") for i in range(90)]
    convs = {1: shared, 2: shared, 3: shared[:40], 4: [], **{10 + i: [("u", "same")] for i in range(30)}}
    assert got(trie.prefix_trie(*tables(tight, convs), height=4)) == plain_nodes(convs)


def raw(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(1) for c in ("node", "parent", "depth", "pos", "band", "donor", "take", "head", "bytes", "key", "id", "rank")})


def test_query_on_messy_rows(spark, tmp_path):
    rows = [(5, None, "u", "first"), (5, 1, "u", None), (5, 1, None, "x"), (5, 1, None, "x"), (5, 2, "", ""), (6, 1, "u", "own"), (7, None, None, None),
            (None, 1, "u", "nobody"), (8, 1, "u", "z" * 300_000), (9, 0, "a", "b"), (23, 1, "u", "orphan"), (100, 1, "a", "ü")]
    rows += [(c, t, "u", f"{t}") for c in range(10, 20) for t in range(12)]
    raw(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op13_conversation_trie(spark, str(tmp_path))
    mine = sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)
    assert mine == plain_nodes(rebuilt(rows))
    assert any(not v for v in rebuilt(rows).values())  # a turnless one is among them


def test_empty_table(spark, tmp_path):
    raw(spark, [(1, 1, "u", "x")]).limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_conversation_trie(spark, str(tmp_path)).count() == 0


def test_subtree_sums_alone(spark):
    # a path of 100 nodes, each worth 1
    paths = spark.createDataFrame([(1, d, str(d)) for d in range(100)], "conv_id long, depth long, node string")
    sums = trie.subtree_sums(paths, paths.withColumn("v", F.lit(1)), ["v"], 4, Scratch(spark))
    assert {int(r["node"]): r["v"] for r in sums.collect()} == {d: 100 - d for d in range(100)}


def test_digest_over_many_pieces(spark):
    ids = spark.range(0, 30_000).select(F.lit("k").alias("k"), "id").union(spark.createDataFrame([("other", 7)], "k string, id long"))
    want = {"k": hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest(), "other": hashlib.sha256(b"7").hexdigest()}
    assert {r["k"]: r["sha256"] for r in trie.id_digests(ids.repartition(5), "k", "id").collect()} == want
