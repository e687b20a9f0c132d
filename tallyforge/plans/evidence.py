"""Queries of the pattern operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..operators.rules import rule_table
from . import adapters as A
from .registry import big, query, rounded, table

EDGE_COLS = "sample, unit, src, dst, technique_id, rule_name, confidence"


@query("ordered_chain", f"WITH {A.EVENT_EDGES_SQL} SELECT {EDGE_COLS} FROM chain_edges")
def ordered_chain(spark, sf):
    return P.ordered_chain(A.event_calls(spark, sf), A.event_rules(spark), A.WINDOW)


@query("set_cooccurrence", f"WITH {A.EVENT_EDGES_SQL} SELECT {EDGE_COLS} FROM pair_edges WHERE technique_id = 'R2'")
def set_cooccurrence(spark, sf):
    return P.set_cooccurrence(A.event_calls(spark, sf), A.event_rules(spark), A.WINDOW)


@query("family_sequence", f"WITH {A.EVENT_EDGES_SQL} SELECT {EDGE_COLS} FROM pair_edges WHERE technique_id = 'R3'")
def family_sequence(spark, sf):
    return P.family_sequence(A.event_calls(spark, sf), A.event_rules(spark), A.WINDOW)


@query("singleton_indicators",
       f"WITH {A.EVENT_EDGES_SQL} SELECT sample, unit, node_id, technique_id, rule_name FROM singles")
def singleton_indicators(spark, sf):
    calls, rules = A.event_calls(spark, sf), A.event_rules(spark)
    pairs = P.set_cooccurrence(calls, rules, A.WINDOW).unionByName(P.family_sequence(calls, rules, A.WINDOW))
    return P.singleton_indicators(calls, pairs, rules)


@query("seed_edges", f"WITH {A.EVENT_EDGES_SQL} SELECT {EDGE_COLS} FROM edges")
def seed_edges(spark, sf):
    return P.seed_edges(A.event_calls(spark, sf), A.event_rules(spark), A.WINDOW)


@query("seed_evidence", f"""WITH {A.EVENT_EDGES_SQL}
  SELECT {EDGE_COLS}, 'edge' AS kind FROM edges
  UNION ALL SELECT sample, unit, node_id, NULL, technique_id, rule_name, NULL, 'indicator' FROM singles""")
def seed_evidence(spark, sf):
    return P.seed_evidence(A.event_calls(spark, sf), A.event_rules(spark), A.WINDOW)


APIS = A.ORDER_RULES[0].apis


@query("cross_unit_chain_1hop", f"""WITH {A.ORDER_GRAPH_SQL},
  {A.chain_sql('ocalls', APIS, A.WINDOW, 'own')},
  own_full AS (SELECT sample, unit FROM own4 WHERE p4 IS NOT NULL),
  offsets AS (SELECT sample, unit, max(position) + 1 AS shift FROM ocalls GROUP BY ALL),
  joint AS (
    SELECT h.sample, h.src || '>' || h.dst AS unit, c.node_id, c.api, c.position, 'p' AS side
    FROM hops h JOIN ocalls c ON c.sample = h.sample AND c.unit = h.src
    WHERE NOT EXISTS (SELECT 1 FROM own_full o WHERE o.unit = h.dst)
    UNION ALL
    SELECT h.sample, h.src || '>' || h.dst, c.node_id, c.api, c.position + shift, 'f'
    FROM hops h JOIN offsets o ON o.unit = h.src JOIN ocalls c ON c.sample = h.sample AND c.unit = h.dst
    WHERE NOT EXISTS (SELECT 1 FROM own_full o WHERE o.unit = h.dst)),
  {A.chain_sql('joint', APIS, A.WINDOW, 'jt')},
  found AS (
    SELECT p.sample, p.unit, a.node_id AS src, b.node_id AS dst, a.side AS sa, b.side AS sb
    FROM jtpairs p JOIN joint a ON a.unit = p.unit AND a.position = p.pa
    JOIN joint b ON b.unit = p.unit AND b.position = p.pb),
  both_sides AS (SELECT unit FROM found GROUP BY unit
    HAVING bool_or(sa = 'p' OR sb = 'p') AND bool_or(sa = 'f' OR sb = 'f'))
  SELECT DISTINCT sample, src, dst, 'O1' AS technique_id, 'line_chain' AS rule_name,
         'cross_function_1hop' AS confidence
  FROM found WHERE unit IN (SELECT unit FROM both_sides)""")
def cross_unit_chain_1hop(spark, sf):
    return P.cross_unit_chain_1hop(A.order_calls(spark, sf), A.order_edges(spark, sf),
                                   rule_table(spark, A.ORDER_RULES), A.WINDOW)


@query("rule_caveats", f"""WITH {A.EVENT_EDGES_SQL}
  SELECT technique_id, count(*) AS n, CASE WHEN technique_id = 'R1' THEN 'order of event names only' END AS caveat
  FROM edges GROUP BY technique_id""")
def rule_caveats(spark, sf):
    report = seed_edges(spark, sf).groupBy("technique_id").agg(F.count(F.lit(1)).alias("n"))
    return P.rule_caveats(report, A.event_rules(spark))


# Every document is a sample; the digits of its words' lengths stand for section entropies.
@query("structural_indicators", f"""WITH e AS (
    SELECT doc_id, list_transform(regexp_extract_all(text, '[^ \\n]+'), lambda w: length(w)::DOUBLE / 4) AS ent,
           n_chars % 40 AS n_imports FROM documents)
  SELECT doc_id, coalesce(list_max(ent), 0.0) AS max_section_entropy, n_imports < 10 AS has_import_table_anomaly,
         coalesce(list_max(ent), 0.0) >= 7.2 OR n_imports < 10 AS is_likely_packed FROM e""")
def structural_indicators(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.transform(F.regexp_extract_all("text", F.lit("([^ \\n]+)")),
                              lambda w: F.length(w).cast("double") / 4).alias("ent"),
        (F.col("n_chars") % 40).alias("n_imports"))
    return P.structural_indicators(docs, "ent", "n_imports").drop("ent", "n_imports")


@query("entropy_stats", """SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean_entropy,
    round(list_max(embedding)::DOUBLE, 6) AS max_entropy, round(list_min(embedding)::DOUBLE, 6) AS min_entropy
  FROM embeddings""")
def entropy_stats(spark, sf):
    df = P.entropy_stats(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return rounded(df.drop("embedding"), "mean_entropy", "max_entropy", "min_entropy")
