"""Queries of duplicate, cluster and lineage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D, graph as G, versions as V
from ..streaming.seen import SeenTable
from . import adapters as A
from .registry import big, query, rounded, table
from .sources import new_dir

THR = 50.0

WORD = D.WORD
#: Distinct five-word shingles of lower-cased texts; all the words of a shorter text; ``POS`` is the scan order.
POS = "md5('scan|' || {id})"


def shingle_sql(table: str, key: str) -> str:
    return f"""(SELECT DISTINCT id, s FROM (
    SELECT id, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') AS s
    FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM (SELECT {key} AS id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM {table}) WHERE len(ws) >= 5)
    UNION ALL SELECT id, len(ws) || '|' || coalesce(array_to_string(ws, ' '), '')
    FROM (SELECT {key} AS id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM {table}) WHERE len(ws) < 5))"""


def sets_sql(order: str) -> str:
    return f"""sh AS {shingle_sql("documents", "doc_id")},
  sets AS (SELECT id, list_sort(list(s)) AS s, count(*) AS n FROM sh GROUP BY id),
  cls AS (SELECT id, s, n, first_value(id) OVER (PARTITION BY s ORDER BY {order}, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM sets),
  firsts AS (SELECT id, s, n FROM cls WHERE id = first)"""


def pairs_sql(thr: float, order: str = "id") -> str:
    return f"""{sets_sql(order)},
  fsh AS (SELECT sh.id, sh.s, n FROM sh JOIN firsts USING (id)),
  hits AS (SELECT a.id AS src, b.id AS dst, count(*) AS k, max(a.n) AS na, max(b.n) AS nb
           FROM fsh a JOIN fsh b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
  pairs AS (SELECT src, dst, 100.0::DOUBLE * k / (na + nb - k) AS similarity FROM hits
            WHERE 100.0::DOUBLE * k / (na + nb - k) >= {thr} - 1e-9
            UNION ALL SELECT first, id, 100.0 FROM cls WHERE id <> first)"""


SETS = sets_sql("id")


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def scanned(spark, sf):
    """Documents with a scan order that is unlike the id."""
    return documents(spark, sf).withColumn("pos", F.md5(F.concat(F.lit("scan|"), F.col("id").cast("string"))))


def pairs(spark, sf, threshold=THR, order=None):
    return D.near_dup_pairs(scanned(spark, sf), "text", threshold, order=order)


@query("near_dup_pairs", f"WITH {pairs_sql(90)} SELECT src, dst, round(similarity, 6) AS similarity FROM pairs")
def near_dup_pairs(spark, sf):
    return rounded(pairs(spark, sf, 90.0), "similarity")


@query("near_dup_pairs_minhash")
def near_dup_pairs_minhash(spark, sf):
    return rounded(D.near_dup_pairs(documents(spark, sf), "text", 90.0, mode="minhash"), "similarity")


@query("max_similarity_to_ref", f"""WITH {SETS}, bs AS {shingle_sql("benchmark", "item_id")},
  bn AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
  k AS (SELECT sh.id, bs.id AS ref, count(*) AS k FROM sh JOIN bs USING (s) GROUP BY ALL),
  sim AS (SELECT k.id, ref, 100.0::DOUBLE * k / (sets.n + bn.n - k) AS similarity
          FROM k JOIN sets ON sets.id = k.id JOIN bn ON bn.id = ref)
  SELECT id, arg_min(ref, (-similarity, ref)) AS best_ref, round(max(similarity), 6) AS similarity
  FROM sim WHERE similarity >= 1 - 1e-9 GROUP BY id""")
def max_similarity_to_ref(spark, sf):
    ref = table(spark, sf, "benchmark").withColumnRenamed("item_id", "ref_id")
    return rounded(D.max_similarity_to_ref(documents(spark, sf), ref, "text", threshold=1.0), "similarity")


REACH = f"""{pairs_sql(THR)},
  both_ways AS (SELECT src AS a, dst AS b FROM pairs UNION ALL SELECT dst, src FROM pairs),
  walk(a, b) AS (SELECT a, b FROM both_ways UNION SELECT w.a, e.b FROM walk w JOIN both_ways e ON e.a = w.b),
  comp AS (SELECT doc_id AS id, least(doc_id, coalesce(min(b), doc_id)) AS cluster
           FROM documents LEFT JOIN walk ON a = doc_id GROUP BY doc_id)"""


@query("connected_components", f"WITH RECURSIVE {REACH} SELECT id, cluster AS component FROM comp")
def connected_components(spark, sf):
    links = D.near_dup_links(documents(spark, sf), "text", THR)
    return G.connected_components(links, documents(spark, sf).select("id"))


def clusters(spark, sf):
    return D.near_dup_clusters(documents(spark, sf), D.near_dup_links(documents(spark, sf), "text", THR))


@query("near_dup_clusters", f"WITH RECURSIVE {REACH} SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM comp")
def near_dup_clusters(spark, sf):
    return clusters(spark, sf)


@query("cluster_stats", f"""WITH RECURSIVE {REACH}, n AS (
    SELECT source, cluster, count(*) AS n FROM comp JOIN documents ON doc_id = id GROUP BY ALL)
  SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_single, max(n) AS largest,
         (sum(n) - count(*))::BIGINT AS redundant, round(100.0::DOUBLE * (sum(n) - count(*)) / sum(n), 6) AS redundant_pct FROM n GROUP BY source""")
def cluster_stats(spark, sf):
    by = clusters(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return rounded(D.cluster_stats(by, "source"), "redundant_pct")


@query("cluster_representative", f"WITH RECURSIVE {REACH} SELECT cluster, min(id) AS representative FROM comp GROUP BY cluster")
def cluster_representative(spark, sf):
    return D.cluster_representative(clusters(spark, sf))


@query("greedy_keep_first", f"""WITH RECURSIVE {pairs_sql(THR, POS.format(id="id"))},
  fp AS (SELECT CASE WHEN {POS.format(id="src")} < {POS.format(id="dst")} THEN src ELSE dst END AS a,
                CASE WHEN {POS.format(id="src")} < {POS.format(id="dst")} THEN dst ELSE src END AS b FROM pairs WHERE similarity < 100),
  live AS (SELECT id, row_number() OVER (ORDER BY {POS.format(id="id")}) AS r FROM (SELECT a AS id FROM fp UNION SELECT b FROM fp)),
  scan AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
    SELECT l.r, CASE WHEN EXISTS (SELECT 1 FROM fp WHERE fp.b = l.id AND list_contains(s.kept, fp.a)) THEN s.kept
                     ELSE list_append(s.kept, l.id) END FROM scan s JOIN live l ON l.r = s.r + 1),
  fin AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM scan ORDER BY r DESC LIMIT 1))
  SELECT doc_id AS id FROM documents
  WHERE doc_id NOT IN (SELECT id FROM cls WHERE id <> first)
    AND (doc_id NOT IN (SELECT id FROM live) OR doc_id IN (SELECT id FROM fin))""")
def greedy_keep_first(spark, sf):
    return D.greedy_keep_first(scanned(spark, sf).select("id", "pos"), pairs(spark, sf, order="pos"), "pos").select("id")


@query("leader_clustering", f"""WITH RECURSIVE {pairs_sql(THR, POS.format(id="id"))},
  ends AS (SELECT src AS a, dst AS b FROM pairs UNION ALL SELECT dst, src FROM pairs),
  up AS (SELECT b AS id, arg_min(a, ({POS.format(id="a")}, a)) AS parent FROM ends WHERE {POS.format(id="a")} < {POS.format(id="b")} GROUP BY b),
  chase AS (SELECT id, parent AS leader FROM up UNION ALL
            SELECT c.id, u.parent FROM chase c JOIN up u ON u.id = c.leader)
  SELECT doc_id AS id, coalesce(arg_min(leader, {POS.format(id="leader")}), doc_id) AS leader FROM documents LEFT JOIN chase ON id = doc_id GROUP BY doc_id""")
def leader_clustering(spark, sf):
    return D.leader_clustering(scanned(spark, sf).select("id", "pos"), pairs(spark, sf, order="pos"), "pos")


@query("exact_dedup", """SELECT doc_id, source, n_chars, sha256(text) AS sha256, count(*) OVER (PARTITION BY text) AS copies
  FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1""")
def exact_dedup(spark, sf):
    return D.exact_dedup(table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars"),
                         "text", ["source", "doc_id"]).drop("text")


@query("anti_known", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_known(spark, sf):
    return D.anti_known(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels"), "doc_id")


@query("anti_known_stored", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_known_stored(spark, sf):
    known = SeenTable(new_dir(spark, "known"), buckets=16)
    known.add(table(spark, sf, "labels").select("doc_id"), "doc_id", 0)
    return known.unseen(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 1)


# Documents divisible by 5 are an earlier version; those with a source that ends in 5 are its holdout.
MATCHES = f"""WITH {SETS}, osh AS (SELECT sh.id, sh.s, n FROM sh JOIN sets USING (id)),
  m AS (SELECT a.id, b.id AS ref, 100.0::DOUBLE * count(*) / (max(a.n) + max(b.n) - count(*)) AS similarity
        FROM osh a JOIN osh b ON a.s = b.s WHERE a.id % 5 <> 0 AND b.id % 5 = 0 GROUP BY ALL)"""


def versions(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    old = docs.filter("id % 5 = 0").withColumnRenamed("id", "ref_id")
    split = F.when(F.col("source").endswith("5"), "holdout").otherwise("train")
    return docs.filter("id % 5 <> 0"), old.withColumn("ref_split", split)


@query("matches_to_ref", f"""{MATCHES} SELECT id, ref AS ref_id, round(similarity, 6) AS similarity FROM m WHERE similarity >= 50 - 1e-9""")
def matches_to_ref(spark, sf):
    new, old = versions(spark, sf)
    return rounded(D.matches_to_ref(new, old, "text", threshold=50.0), "similarity")


@query("inherit_split", f"""{MATCHES},
  r AS (SELECT m.id, similarity, CASE WHEN source LIKE '%5' THEN 'holdout' ELSE 'train' END AS ref_split
        FROM m JOIN documents d ON d.doc_id = ref WHERE similarity >= 50 - 1e-9),
  best AS (SELECT id, max(similarity) AS similarity, bool_or(ref_split = 'holdout') AS held, arg_min(ref_split, (-similarity, ref_split)) AS ref_split FROM r GROUP BY id),
  d AS (SELECT doc_id AS id, similarity, held, ref_split FROM documents LEFT JOIN best ON id = doc_id WHERE doc_id % 5 <> 0)
  SELECT id, CASE WHEN similarity < 100 AND NOT held THEN ref_split END AS split,
         CASE WHEN similarity IS NULL THEN 'new' WHEN similarity >= 100 THEN 'drop_identical'
              WHEN held THEN 'drop_holdout' ELSE 'inherit' END AS decision FROM d""")
def inherit_split(spark, sf):
    new, old = versions(spark, sf)
    matches = D.matches_to_ref(new, old, "text", by="ref_split", threshold=50.0)
    return D.inherit_split(new.select("id"), matches, ["holdout"], least=50.0)


@query("provenance_join", """WITH log AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS src FROM orders GROUP BY o_custkey)
  SELECT c_custkey, c_mktsegment, coalesce(src, c_mktsegment) AS source FROM customer LEFT JOIN log ON o_custkey = c_custkey""")
def provenance_join(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("source"),
                                            F.struct("o_orderdate", "o_orderkey").alias("at"))
    return D.provenance_join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), log, "c_mktsegment", "c_custkey")


@query("dataset_union_version", """SELECT doc_id AS id, lang, NULL::BIGINT AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)""")
def dataset_union_version(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    new = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "lang", F.col("quality").cast("long").alias("quality"))
    return D.dataset_union_version(D.anti_known(docs, labels, "doc_id").select(F.col("doc_id").alias("id"), "lang"), new)


@query("dataset_fingerprint", A.tree_sql("""SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_returnflag, l_linestatus)) AS h FROM lineitem"""))
def dataset_fingerprint(spark, sf):
    return D.dataset_fingerprint(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))


@query("dataset_fingerprint_xor", """WITH h AS (SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_returnflag, l_linestatus)) AS h FROM lineitem)
  SELECT bit_xor(('0x' || substr(h, 1, 15))::BIGINT) || ':' || bit_xor(('0x' || substr(h, 16, 15))::BIGINT) || ':' ||
         sum(('0x' || substr(h, 31, 15))::BIGINT % 1000003) AS fingerprint, count(*) AS n_rows FROM h""")
def dataset_fingerprint_xor(spark, sf):
    return D.dataset_fingerprint(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), "xor")


# The new version lacks one order in 97, has one line in 89 twice, and has another quantity in one in 83.
@query("fingerprint_diff", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS l_quantity FROM lineitem),
  b0 AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_orderkey + l_linenumber) % 83 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
         FROM a WHERE l_orderkey % 97 <> 0),
  b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE (l_orderkey + l_linenumber) % 89 = 0),
  x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(o)::BIGINT AS n_old, sum(n)::BIGINT AS n_new
        FROM (SELECT *, 1 AS o, 0 AS n FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY ALL)
  SELECT CASE WHEN n_old = 0 THEN 'added' WHEN n_new = 0 THEN 'removed' ELSE 'repeated' END AS change, * FROM x WHERE n_old <> n_new""")
def fingerprint_diff(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"))
    place = F.col("l_orderkey") + F.col("l_linenumber")
    new = old.filter("l_orderkey % 97 <> 0").withColumn("l_quantity", F.col("l_quantity") + F.when(place % 83 == 0, 1.0).otherwise(0.0))
    new = new.unionByName(new.filter(place % 89 == 0))
    versions = [V.freeze(df, new_dir(spark, "version")) for df in (old, new)]
    return V.fingerprint_diff(spark, *versions).select("change", "row.*", "n_old", "n_new")
