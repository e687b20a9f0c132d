"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query, table
from . import ann, chat, crosstoken, decontam, langid, licenses, linededup, mixing, ngramjoin, sharding, trie, urlfilter, warc
from .common import Scratch


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------ 5 mixing

MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM s),
-- deal, cap, deal the excess again: a round fixes the sources that are above their cap
rounds AS (
  SELECT 0 AS n, list({'source': source, 'cap': 2.0 * source_size, 'w': w, 'target': NULL::DOUBLE}) AS src,
         1.5 * sum(source_size) AS rest FROM w
  UNION ALL
  SELECT n + 1, nxt, rest - list_sum(list_transform(src2, lambda x: CASE WHEN x.target IS NULL AND x.w * lvl > x.cap THEN x.cap ELSE 0 END))
  FROM (SELECT n, rest, src AS src2, lvl,
               list_transform(src, lambda x: {'source': x.source, 'cap': x.cap, 'w': x.w,
                 'target': CASE WHEN x.target IS NULL AND x.w * lvl > x.cap THEN x.cap ELSE x.target END}) AS nxt
        FROM (SELECT n, src, rest, rest / nullif(list_sum(list_transform(src, lambda x: CASE WHEN x.target IS NULL THEN x.w ELSE 0 END)), 0) AS lvl
              FROM rounds) q
        WHERE list_sum(list_transform(src, lambda x: CASE WHEN x.target IS NULL AND x.w * lvl > x.cap THEN 1 ELSE 0 END)) > 0) r),
fin AS (SELECT src, rest / nullif(list_sum(list_transform(src, lambda x: CASE WHEN x.target IS NULL THEN x.w ELSE 0 END)), 0) AS lvl
        FROM rounds ORDER BY n DESC LIMIT 1),
t AS (SELECT x.source AS source, coalesce(x.target, least(x.cap, x.w * lvl)) AS target FROM (SELECT unnest(src) AS x, lvl FROM fin)),
p AS (SELECT d.*, s.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, CAST(doc_id AS VARCHAR), d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END * size
            + least(size, greatest(0, CAST(floor(target) AS BIGINT) - CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
FROM p
"""


@query("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark, sf_dir):
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "taken")


# ------------------------------------------------------------------ 9 sharding


@query("op9_shard_groups")
def op9_shard_groups(spark, sf_dir):
    out = sharding.shard_by_size(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


# ------------------------------------------------------------------ 10 licences


def _canonical_sql(col: str) -> str:
    """The canonical lines of ``col`` as a DuckDB list."""
    low = f"translate({col}, '{licenses.UPPER}', '{licenses.LOWER}')"
    bare = (f"regexp_replace(regexp_replace({low}, {_sql_text(licenses.COPYRIGHT_LINE)}, '\\1', 'g'), "
            f"{_sql_text(licenses.RIGHTS_LINE)}, '\\1\n', 'g')")
    words = f"regexp_replace(translate({bare}, '{licenses.SIGNS}', '{' ' * len(licenses.SIGNS)}'), '{licenses.ASCII_BREAKS}', ' ', 'g')"
    lines = f"list_filter(list_transform(string_split({words}, '\n'), lambda x: trim(x, ' ')), lambda x: x <> '')"
    spell = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in licenses.SPELLINGS.items()) + "}"
    return (f"list_transform({lines}, lambda l: array_to_string(list_transform(string_split(l, ' '), "
            f"lambda w: coalesce({spell}[w], w)), ' '))")


LICENSE_SQL = f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in licenses.LICENSES)}) v(license, text)),
known AS (SELECT sha256(array_to_string({_canonical_sql("text")}, ' ')) AS digest, min(license) AS license FROM k GROUP BY 1),
lines AS (SELECT doc_id, coalesce({_canonical_sql("text")}, []) AS ls FROM documents),
units AS (SELECT doc_id, unnest(list_concat([array_to_string(ls, ' ')], ls)) AS u, unnest(range(0, len(ls) + 1)) AS unit FROM lines),
hashed AS (SELECT doc_id, CAST(unit AS INTEGER) AS unit, sha256(u) AS digest FROM units)
SELECT doc_id, unit, h.digest, license FROM hashed h LEFT JOIN known k ON h.digest = k.digest WHERE unit = 0 OR license IS NOT NULL
"""


@query("op10_license_scan", LICENSE_SQL)
def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


# ------------------------------------------------------------------ 6 WARC

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest
"""


@query("op6_warc_normalise", WARC_SQL)
def op6_warc_normalise(spark, sf_dir):
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ------------------------------------------------------------------ 2 decontamination

DECONTAM_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)),
m AS (SELECT o.doc_id, o.i, o.k, win.item FROM occ o JOIN win ON o.k = win.k AND o.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query("op2_decontaminate", DECONTAM_SQL)
def op2_decontaminate(spark, sf_dir):
    judge = decontam.contamination(table(spark, sf_dir, "benchmark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", judge(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.n_words", "r.n_hit", "r.n_items", "r.items_sha256", "r.contaminated")


# ------------------------------------------------------------------ 7 language ID


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.in_training(F.col("doc_id"))))
    judged = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.classify(model, spark)(F.col("text")).alias("r"))
    return judged.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score")


# ------------------------------------------------------------------ 1 nearest neighbours

ANN_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score
      FROM e q JOIN e ON q.r <> e.r AND len(q.v) = len(e.v) WHERE q.vec_id % 20 = 0),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


@query("op1_onebit_search", ANN_SQL)
def op1_onebit_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


# ------------------------------------------------------------------ 4 n-gram Jaccard join

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * inter >= 85 * (p.n + q.n - inter)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY 1) m ON m.x = d.doc_id
"""


@query("op4_jaccard_join", JACCARD_SQL)
def op4_jaccard_join(spark, sf_dir):
    return ngramjoin.near_copies(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 3 URL filter

#: The rules of the list.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

URL_SQL = r"""
WITH RECURSIVE p0 AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
p1 AS (SELECT r, page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
              regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS low FROM p0),
rl(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
hit AS (SELECT r, max_by(rule, len(rule)) AS rule, max_by(verdict, len(rule)) AS listed FROM p1 JOIN rl
        ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
           AND starts_with(path, '/' || substr(rule, strpos(rule, '/') + 1)) GROUP BY r),
lab AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 'block' ELSE 'allow' END) AS label FROM labels GROUP BY 1),
p AS (SELECT p1.*, rule, listed, coalesce(listed, label) AS label FROM p1 LEFT JOIN hit ON p1.r = hit.r LEFT JOIN lab ON page_id = doc_id),
parts AS (SELECT r, regexp_extract(low, '://([^/?#]*)', 1) AS h, regexp_extract(low, '://[^/?#]*([^?#]*)', 1) AS q, low FROM p),
tok AS (SELECT DISTINCT r, t FROM (
  SELECT r, 'h:' || x AS t FROM (SELECT r, unnest(string_split(h, '.')) AS x FROM parts) WHERE x <> ''
  UNION ALL SELECT r, 'p:' || x FROM (SELECT r, unnest(string_split(q, '/')) AS x FROM parts) WHERE x <> ''
  UNION ALL SELECT r, '1:' || split_part(q, '/', 2) FROM parts WHERE split_part(q, '/', 2) <> ''
  UNION ALL SELECT r, 'e:' || regexp_extract(q, '\.([a-z0]+)$', 1) FROM parts WHERE regexp_extract(q, '\.([a-z0]+)$', 1) <> ''
  UNION ALL SELECT r, 'q:' || x FROM (SELECT r, regexp_replace(unnest(string_split(regexp_extract(low, '\?([^#]*)', 1), '&')), '=.*', '') AS x FROM parts) WHERE x <> ''
  UNION ALL SELECT r, '#' FROM parts WHERE contains(low, '#'))),
lt AS (SELECT tok.r, t, label FROM tok JOIN p ON p.r = tok.r WHERE label IS NOT NULL),
least_n AS (SELECT ceil(0.005 * count(DISTINCT r)) AS m FROM lt),
fr AS (SELECT t FROM lt GROUP BY t HAVING count(*) >= (SELECT m FROM least_n)),
f AS (SELECT lt.* FROM lt JOIN fr ON fr.t = lt.t),
sets AS (SELECT r, label, [t] AS s, t FROM f
  UNION ALL SELECT a.r, a.label, list_append(a.s, b.t), b.t FROM sets a JOIN f b ON a.r = b.r AND a.t < b.t),
cnt AS (SELECT s, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY s) AS total FROM sets GROUP BY s, label),
led AS (SELECT s, label, n, n / total AS conf FROM cnt WHERE n >= (SELECT m FROM least_n)),
parts_of AS (SELECT s, label, n, conf, list_filter(s, lambda x: x <> gone) AS part FROM (SELECT *, unnest(s) AS gone FROM led WHERE len(s) > 1)),
best AS (SELECT s, label, n, conf, -1.0::DOUBLE AS sub, conf AS top FROM led WHERE len(s) = 1
  UNION ALL SELECT p.s, p.label, p.n, p.conf, max(b.top), greatest(p.conf, max(b.top)) FROM best b JOIN parts_of p ON p.part = b.s AND p.label = b.label
  GROUP BY p.s, p.label, p.n, p.conf),
kept AS (SELECT *, row_number() OVER (ORDER BY conf DESC, n DESC, len(s) DESC, array_to_string(s, ' '), label) AS id FROM best WHERE conf >= 0.8 AND sub < conf),
pt AS (SELECT r, list(t) AS ts FROM tok GROUP BY r),
chosen AS (SELECT r, min_by(label, id) AS label FROM pt JOIN kept ON len(list_intersect(s, ts)) = len(s) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(listed, chosen.label, 'allow') AS verdict FROM p LEFT JOIN chosen ON p.r = chosen.r
"""


@query("op3_url_filter", URL_SQL)
def op3_url_filter(spark, sf_dir):
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("label"))
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------ 8 chat formatting


@query("op8_chat_format")
def op8_chat_format(spark, sf_dir):
    turns = chat.recover_roles(table(spark, sf_dir, "conversations"))
    return turns.select(F.col("conv").cast("long").alias("conv_id"), "turn", "role", "text", "rendered")


# ------------------------------------------------------------------ 12 line dedup

LINES_SQL = r"""
WITH l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
           FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT r, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key
        HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, rep.key IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN rep ON k.key = rep.key)
GROUP BY r, doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def op12_line_dedup(spark, sf_dir):
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 13 conversation trie

TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
orig AS (SELECT c, list(x ORDER BY pos) AS xs FROM t GROUP BY c),
-- CRC-32 of the decimal digits: eight steps per byte
h AS (SELECT c, xs, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ord(d)::BIGINT)),
        lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a // 2, (a % 2) * 3988292384))), 4294967295) % 9 AS h FROM orig),
conv AS (SELECT h.c, list_concat(coalesce(d.xs[1:h], []), h.xs[h + 1:]) AS xs FROM h LEFT JOIN orig d ON d.c = h.c - h.c % 5),
m AS (SELECT c, len(xs) AS n, unnest(range(0, len(xs) + 1)) AS depth, xs FROM conv),
p AS (SELECT c, n, depth, sha256(CAST(to_json(xs[1:depth]) AS VARCHAR)) AS node, CASE WHEN depth > 0 THEN sha256(CAST(to_json(xs[1:depth - 1]) AS VARCHAR)) END AS parent,
             CASE WHEN depth > 0 THEN octet_length(encode(xs[depth].t)) ELSE 0 END AS bytes FROM m),
nodes AS (SELECT node, depth, min(c) AS conv_id, min(parent) AS parent, count(*) AS n_convs, max(bytes) AS bytes,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM p GROUP BY node, depth),
kids AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
v AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.node),
tot AS (SELECT p.node, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved_tokens
        FROM v JOIN p ON p.c = v.conv_id AND p.depth <= v.depth GROUP BY p.node)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       v.ends_sha256
FROM v JOIN tot ON tot.node = v.node LEFT JOIN v u ON u.node = v.parent
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13_conversation_trie(spark, sf_dir):
    scratch = Scratch(spark)
    turns = scratch.write(trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    convs = turns.select("conv_id").distinct()
    conv = F.col("conv_id")
    plan = convs.select("conv_id", (conv - conv % 5).alias("donor"), (F.crc32(conv.cast("string").cast("binary")) % 9).alias("take"))
    built = trie.prefix_trie(convs, trie.with_openings(turns, plan, longest=8))
    digests = trie.id_digests(built.ends, "node", "conv_id")
    joined = built.nodes.join(digests, "node", "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


# ------------------------------------------------------------------ 11 cross-tokenizer alignment


@query("op11_cross_tokenizer")
def op11_cross_tokenizer(spark, sf_dir):
    settings = crosstoken.Settings(first="/opt/tokenizers/byte_bpe_50k.json", second="/opt/tokenizers/piece_bpe_32k.model")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise(F.lit(""))
    return crosstoken.aligned_documents(table(spark, sf_dir, "documents"), settings, {"groups_sha256": digest})
