"""Golden cases and traps of the rule matchers."""

import random

import pytest

from tallyforge.operators import flatten as FL, patterns as P
from tallyforge.operators.rules import CHAIN, Rule, rule_table

CALLS = "sample long, unit string, node_id string, api string, position long"


def calls(spark, rows, unit="u"):
    return spark.createDataFrame([(1, unit, n, a, p) for n, a, p in rows], CALLS)


SMOKE = [("n1", "OpenProcess", 3), ("n2", "SomeUnrelatedCall", 5), ("n3", "VirtualAllocEx", 7),
         ("n4", "WriteProcessMemory", 12), ("n5", "CreateRemoteThread", 15), ("n6", "InternetOpenA", 20),
         ("n7", "IsDebuggerPresent", 30), ("n8", "CreateServiceW", 40)]


def pairs(df):
    return sorted((r["src"], r["dst"], r["confidence"]) for r in df.collect())


def test_smoke_case(spark):
    c, rules = calls(spark, SMOKE), rule_table(spark)
    assert pairs(P.seed_edges(c, rules)) == [("n1", "n3", "full_chain"), ("n3", "n4", "full_chain"), ("n4", "n5", "full_chain")]
    ev = P.seed_evidence(c, rules).filter("kind = 'indicator'").collect()
    assert sorted((r["src"], r["technique_id"]) for r in ev) == [("n6", "T1071"), ("n7", "T1497"), ("n8", "T1547")]


def test_no_first_step_no_chain(spark):
    assert pairs(P.ordered_chain(calls(spark, SMOKE[2:]), rule_table(spark))) == []


def test_greedy_without_backtracking(spark):
    # the first A is too far from B; the second would fit, but the walk does not come back
    rule = rule_table(spark, [Rule("R", "r", CHAIN, apis=("A", "B", "C"))])
    c = calls(spark, [("a1", "A", 0), ("a2", "A", 8), ("b", "B", 10), ("c", "C", 11)])
    assert pairs(P.ordered_chain(c, rule)) == []
    c = calls(spark, [("a", "A", 0), ("b", "B", 8), ("c", "C", 17)])
    assert pairs(P.ordered_chain(c, rule)) == [("a", "b", "partial_chain")]


def test_repeated_step(spark):
    rule = rule_table(spark, [Rule("R", "r", CHAIN, apis=("A", "B", "A"))])
    c = calls(spark, [("a", "A", 0), ("b", "B", 1), ("x", "A", 2)])
    assert pairs(P.ordered_chain(c, rule)) == [("a", "b", "full_chain"), ("b", "x", "full_chain")]


def test_one_site_with_two_apis_pairs_with_itself(spark):
    c = calls(spark, [("n", "RegSetValueExW", 0), ("n", "CreateServiceW", 1)])
    edges = P.set_cooccurrence(c, rule_table(spark))
    assert pairs(edges) == [("n", "n", "co_occurrence")]
    assert P.singleton_indicators(c, edges, rule_table(spark)).count() == 0


def test_chain_across_units(spark):
    parent = calls(spark, [("p1", "OpenProcess", 0), ("p2", "Other", 4)], "p")
    child = calls(spark, [("c1", "VirtualAllocEx", 0), ("c2", "WriteProcessMemory", 1), ("c3", "CreateRemoteThread", 2)], "f")
    both = parent.unionByName(child)
    edge = spark.createDataFrame([(1, "p", "f"), (1, "f", "f")], "sample long, src string, dst string")
    rules = rule_table(spark)
    assert pairs(P.ordered_chain(both, rules)) == []
    assert [p[:2] for p in pairs(P.cross_unit_chain_1hop(both, edge, rules))] == [("c1", "c2"), ("c2", "c3"), ("p1", "c1")]
    # the shift counts all calls of the caller: one more call far behind breaks the window
    far = both.unionByName(calls(spark, [("p3", "Other", 9)], "p"))
    assert pairs(P.cross_unit_chain_1hop(far, edge, rules)) == []


def walk(calls, apis, window):
    """Greedy chain over (node, api, position) rows, written as the rule reads."""
    found, at = [], None
    for api in apis:
        later = sorted((p, n) for n, a, p in calls if a == api and (at is None or p > at))
        if not later or (at is not None and later[0][0] - at > window):
            break
        at = later[0][0]
        found.append(later[0][1])
    return found


def plain_1hop(units, edges, rules, window):
    out = set()
    for rule in rules:
        for src, dst in edges:
            if src == dst or src not in units or dst not in units:
                continue
            own = walk(units[dst], rule.apis, window)
            if len(own) == len(rule.apis) and len(own) >= rule.min_len:
                continue
            shift = max(p for _, _, p in units[src]) + 1
            found = walk(units[src] + [(n, a, p + shift) for n, a, p in units[dst]], rule.apis, window)
            sides = {n in {x for x, _, _ in units[src]} for n in found}
            if len(found) >= max(rule.min_len, 2) and len(sides) == 2:
                out |= {(a, b, rule.technique_id) for a, b in zip(found, found[1:])}
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_chains_across_random_units(spark, seed):
    rnd = random.Random(seed)
    rules = [Rule("R1", "r1", CHAIN, apis=("A", "B", "C", "D")), Rule("R2", "r2", CHAIN, apis=("A", "B", "A"), min_len=3), Rule("R3", "r3", CHAIN, apis=("C", "A"))]
    units = {}
    for u in range(60):
        step = rnd.choice([1, 1, 3])
        units[f"u{u}"] = [(f"u{u}n{i}", rnd.choice("ABCDxyz" if u % 2 else "ABCD"), i * step + rnd.randrange(step)) for i in range(rnd.randint(1, 14))]
    edges = [(f"u{rnd.randrange(62)}", f"u{rnd.randrange(62)}") for _ in range(400)]
    c = spark.createDataFrame([(1, u, n, a, p) for u, rows in units.items() for n, a, p in rows], CALLS)
    e = spark.createDataFrame([(1, a, b) for a, b in edges + edges[:20]], "sample long, src string, dst string")
    got = P.cross_unit_chain_1hop(c, e, rule_table(spark, rules), 4)
    want = plain_1hop(units, set(edges), rules, 4)
    assert want and sorted((r["src"], r["dst"], r["technique_id"]) for r in got.collect()) == want


def test_structural(spark):
    df = spark.createDataFrame([([6.1, 7.6, 5.0], 20), ([], 20), (None, 3)], "e array<double>, n int")
    got = [tuple(r)[2:] for r in P.structural_indicators(df, "e", "n").collect()]
    assert got == [(7.6, False, True), (0.0, False, False), (0.0, True, True)]


def test_unit_keys_and_api_lists(spark):
    df = spark.createDataFrame([("func_70",), ("func_1200",), ("func_0x40",), ("func_ff",), ("odd",), ("func_g1",)], "k string")
    assert [r["position"] for r in FL.unit_position(df, "k").collect()] == [70, 1200, 64, 255, 0, 0]


def test_branches_start_from_one_written_match(spark):
    """The calls are read to find names and to match them; what follows reads the matches."""
    import __spark_entry__ as entry
    plan = entry.queries()["seed_edges"](spark, "/root/testdata/sf0.001")
    assert not [f for f in plan.inputFiles() if f.endswith("events.parquet")]
