"""Queries of readers, writers and row filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import flatten as FL
from ..scale import shared_dir
from ..sources import files as IO
from ..sources.samples import read_sample_json, write_sample_json
from . import adapters as A
from .registry import big, query, rounded, table


def new_dir(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_graph_json", f"""WITH {A.DOC_NODES_SQL}, n AS (SELECT sample, count(*) AS n FROM dnodes GROUP BY sample)
  SELECT doc_id::VARCHAR AS sample_id, (doc_id % 2)::BIGINT AS label, n_chars AS file_size,
         len(string_split(text, chr(10))) AS n_units, coalesce(n, 0) AS n_nodes
  FROM documents LEFT JOIN n ON sample = doc_id""")
def read_graph_json(spark, sf):
    path = new_dir(spark, "records")
    IO.write_graph_json(A.graph_records(spark, sf), path)
    rec = IO.read_graph_json(spark, path, "*.json")
    n_nodes = F.aggregate(F.map_values(FL.UNITS), F.lit(0), lambda a, u: a + F.size(u["nodes"]))
    return big(rec.select("sample_id", "label", "file_size", F.size(FL.UNITS).alias("n_units"), n_nodes.alias("n_nodes")),
               "label", "n_units", "n_nodes")


@query("write_graph_json", f"""WITH {A.DOC_NODES_SQL}, n AS (SELECT sample, count(*) AS n FROM dnodes GROUP BY sample)
  SELECT doc_id::VARCHAR AS sample_id, doc_id::VARCHAR AS file_sample, (doc_id % 2)::BIGINT AS label, n_chars AS file_size,
         coalesce(n, 0) AS n_nodes, 1::BIGINT AS n_records FROM documents LEFT JOIN n ON sample = doc_id""")
def write_graph_json(spark, sf):
    path = new_dir(spark, "samples")
    write_sample_json(A.graph_records(spark, sf), path, suffix=IO.SAMPLE_SUFFIX + ".gz")
    rec = read_sample_json(spark, path)
    n_nodes = F.aggregate(F.map_values(FL.UNITS), F.lit(0), lambda a, u: a + F.size(u["nodes"]))
    per_file = rec.select("sample_id", IO.path_sample_id(F.col("file")).alias("file_sample"), "label", "file_size", n_nodes.alias("n_nodes"))
    return big(per_file.groupBy("sample_id", "file_sample", "label", "file_size", "n_nodes").agg(F.count(F.lit(1)).alias("n_records")), "label", "n_nodes")


@query("write_manifest_sorted", """SELECT doc_id::VARCHAR AS sha256, quality AS label, source, NULL::BIGINT AS num_functions,
    NULL::VARCHAR AS cluster, lang AS split FROM documents JOIN labels USING (doc_id)""")
def write_manifest_sorted(spark, sf):
    path = new_dir(spark, "manifest")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    IO.write_manifest_sorted(docs.select(F.col("doc_id").cast("string").alias("sha256"), F.col("quality").alias("label"),
                                         "source", F.col("lang").alias("split")), path, "sha256")
    return read_jsonl_manifest(spark, path)


def read_jsonl_manifest(spark, path):
    return IO.read_jsonl_manifest(spark, path).drop("orig_name", "vendor")


@query("read_jsonl_manifest", "SELECT s_suppkey::VARCHAR AS sha256, s_nationkey % 2 AS label, s_name AS source FROM supplier")
def read_manifest(spark, sf):
    path = new_dir(spark, "suppliers")
    (table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sha256"),
                                         (F.col("s_nationkey") % 2).alias("label"), F.col("s_name").alias("source"))
     .write.json(path))
    return IO.read_jsonl_manifest(spark, path).select("sha256", "label", "source")


@query("write_result_table", "SELECT n_name, n_regionkey FROM nation")
def write_result_table(spark, sf):
    path = new_dir(spark, "result")
    IO.write_result_table(table(spark, sf, "nation").select("n_name", "n_regionkey"), path, "nation", "round trip")
    return IO.read_result_table(spark, path, "n_name string, n_regionkey int")


NATION_HASH_SQL = A.tree_sql("SELECT sha256(concat_ws('|', n_name, n_regionkey)) AS h FROM nation")


@query("result_table_outputs", rf"""WITH fp AS ({NATION_HASH_SQL}),
  cells AS (SELECT n_name AS a, n_regionkey::VARCHAR AS b FROM nation)
  SELECT 'csv' AS output, unnest(['# source: nation', '# note: all outputs', 'n_name,n_regionkey']) AS line UNION ALL SELECT 'csv', a || ',' || b FROM cells
  UNION ALL SELECT 'latex', unnest(['% source: nation', '% note: all outputs', '\begin{{tabular}}{{lr}}', '\toprule', 'n\_name & n\_regionkey \\', '\midrule',
                                    '\bottomrule', '\end{{tabular}}']) UNION ALL SELECT 'latex', replace(a, '_', '\_') || ' & ' || b || ' \\' FROM cells
  UNION ALL SELECT 'manifest', unnest(['# Result tables', '', '| table | files | source | fingerprint | rows |', '|---|---|---|---|---|', ''])
  UNION ALL SELECT 'manifest', '| nations | nations/csv, nations/latex | nation | ' || substr(fingerprint, 1, 16) || ' | ' || n_rows || ' |' FROM fp
  UNION ALL SELECT 'manifest', '- nations = ' || fingerprint FROM fp""")
def result_table_outputs(spark, sf):
    base = new_dir(spark, "results")
    IO.write_result_table(table(spark, sf, "nation").select("n_name", "n_regionkey"), f"{base}/nations", "nation", "all outputs")
    IO.write_table_manifest(spark, base, ["nations"])
    texts = [spark.read.text(path).select(F.lit(name).alias("output"), F.col("value").alias("line"))
             for name, path in (("csv", f"{base}/nations/csv"), ("latex", f"{base}/nations/latex"), ("manifest", f"{base}/TABLES_MANIFEST"))]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])


@query("read_event_log", "SELECT user_id::VARCHAR AS app, event_type AS step, count(*) AS n FROM events GROUP BY ALL")
def read_event_log(spark, sf):
    path = new_dir(spark, "log")
    (table(spark, sf, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"),
                                       F.col("user_id").cast("string").alias("app"), F.col("event_type").alias("step"))
     .write.json(path))
    return IO.read_event_log(spark, path).groupBy("app", "step").agg(F.count(F.lit(1)).alias("n"))


@query("sample_id_from_path", r"""SELECT page_id, regexp_replace(list_last(string_split(url || '_static.json', '/')), '(_static)?\.json$', '') AS sample FROM pages""")
def sample_id_from_path(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("_static.json")).alias("path"))
    return IO.sample_id_from_path(pages, "path").drop("path")


@query("scan_label_fast", "SELECT event_id, (props->>'$.k')::BIGINT AS label FROM events")
def scan_label_fast(spark, sf):
    return IO.scan_label_fast(table(spark, sf, "events").select("event_id", "props"), "props", "k").drop("props")


# Every seventh page is damaged, pages come twice, and pages divisible by 5 are known already.
@query("ingest_binary_dir", """WITH f AS (
    SELECT page_id, c, 'a/' || page_id AS path, CASE WHEN page_id % 7 = 0 THEN substr(html, 2) ELSE html END AS html FROM pages, (VALUES (0)) t(c)
    UNION ALL SELECT page_id, 1, 'b/' || page_id, CASE WHEN page_id % 7 = 0 THEN substr(html, 2) ELSE html END FROM pages),
  h AS (SELECT *, sha256(html) AS sha256, starts_with(html, '<!') AS magic_ok, octet_length(encode(html)) AS length FROM f),
  k AS (SELECT sha256(html) AS sha256 FROM pages WHERE page_id % 5 = 0)
  SELECT path, length, sha256, magic_ok, CASE WHEN NOT magic_ok THEN 'bad_magic'
    WHEN sha256 IN (SELECT sha256 FROM k) OR path <> min(path) OVER (PARTITION BY sha256) THEN 'already_present' ELSE 'import' END AS reason FROM h""")
def ingest_binary_dir(spark, sf):
    pages = table(spark, sf, "pages")
    html = F.when(F.col("page_id") % 7 == 0, F.substring("html", 2, 1 << 30)).otherwise(F.col("html"))
    blob = pages.select("page_id", html.cast("binary").alias("content"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("d"))
    files = blob.select(F.concat_ws("/", "d", "page_id").alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
    known = pages.filter("page_id % 5 = 0").select(F.sha2("html", 256).alias("sha256"))
    return IO.ingest_binary_dir(files, "<!", known)


@query("metadata_prefilter", "SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size <= 30")
def metadata_prefilter(spark, sf):
    return IO.metadata_prefilter(table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), ["ECONOMY", "PROMO"], 30, "p_type", "p_size")


@query("filename_exclusion", "SELECT p_partkey, p_name FROM part WHERE NOT (p_name ILIKE 'cold%' OR p_name ILIKE '%gadget%')")
def filename_exclusion(spark, sf):
    return IO.filename_exclusion(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["(?i)^cold", "(?i)gadget"])


@query("group_membership_join", """SELECT doc_id AS sample, quality, g AS "group" FROM labels JOIN (
    SELECT doc_id, unnest([lang, source]) AS g FROM documents WHERE n_chars % 9 <> 0) USING (doc_id) WHERE g IN ('en', 'de', 'src1', 'src2')""")
def group_membership_join(spark, sf):
    groups = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.array("lang", "source").alias("groups"),
                                                  (F.col("n_chars") % 9 == 0).alias("error"))
    members = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"), "quality")
    return IO.group_membership_join(members, groups, ["en", "de", "src1", "src2"])
