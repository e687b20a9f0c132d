"""URL filter: a list of host and path rules, and association rules over URL tokens for what the list leaves open.

Spark's FP-growth mines combinations of URL tokens together with a label. Rules with enough support and confidence
stay, unless a part of their tokens says the same at least as surely. A URL is matched through an inverted index from
tokens to rules: a rule fires when as many of its tokens meet as it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import may_broadcast
from .common import Scratch, running_sums

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Settings:
    support: float = 0.005
    confidence: float = 0.8


def host_of(url: Column | str) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule ``host/path`` that fits the host or a domain above it, with a path that begins like its own."""
    fits = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        at, _, rest = rule.partition("/")
        hit = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        fits = F.when(hit, F.lit(rule)).otherwise(fits)
    return fits


def listed_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def url_tokens(url: Column | str) -> Column:
    """Distinct tokens: labels of the host, places and parts of the path, names of query fields, and a fragment.

    Runs of digits become ``0``, so pages of a series are alike. A null URL has none.
    """
    low = F.regexp_replace(F.translate(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), UPPER, LOWER), "[0-9]+", "0")
    host, path = F.regexp_extract(low, "://([^/?#]*)", 1), F.regexp_extract(low, "://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(low, r"\?([^#]*)", 1)
    named = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    ending = F.regexp_extract(path, r"\.([a-z0]+)$", 1)
    return F.array_distinct(F.concat(
        named("h:", F.split(host, r"\.")), named("p:", F.split(path, "/")), named("1:", F.array(F.split_part(path, F.lit("/"), F.lit(2)))),
        named("e:", F.array(ending)), named("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "=.*", ""))),
        F.when(low.contains("#"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))))


def mine_rules(labelled: DataFrame, scratch: Scratch, settings: Settings = Settings(), url_col: str = "url",
               label_col: str = "label") -> DataFrame:
    """(rule_id, tokens, label, confidence, n) from (url, label): one row per rule, ids in order of strength.

    ``n`` counts the labelled URLs with the tokens and the label; it is at least ``support`` of all of them, and
    ``confidence`` is its share of the URLs with the tokens. A rule goes if some of its tokens alone give the label
    with the same or a higher confidence; rules of any length are mined. Null labels and URLs without tokens take no part; no labels, no rules.
    """
    mark = "label="
    baskets = (labelled.select(url_tokens(F.col(url_col)).alias("t"), F.col(label_col).cast("string").alias("l"))
               .filter(F.col("l").isNotNull() & (F.size("t") > 0))
               .select(F.concat("t", F.array(F.concat(F.lit(mark), "l"))).alias("items")))
    baskets = scratch.write(baskets, "baskets")
    total = baskets.count()
    if not total:
        return scratch.spark.createDataFrame([], "rule_id int, tokens array<string>, label string, confidence double, n long")
    model = FPGrowth(itemsCol="items", minSupport=settings.support, minConfidence=settings.confidence).fit(baskets)
    # only sets that lead to a label are of use: a set with the label over the set without it is the rule's confidence
    split = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(mark))).alias("tokens"),
                                      F.get(F.filter("items", lambda x: x.startswith(mark)), F.lit(0)).alias("l"), F.col("freq").alias("n"))
    split = scratch.write(split.filter(F.size("tokens") > 0).withColumn("key", F.array_join("tokens", " ")), "sets")
    sets = (split.filter(F.col("l").isNotNull()).withColumn("label", F.substring("l", len(mark) + 1, 1 << 30)).drop("l")
            .join(split.filter(F.col("l").isNull()).select("key", F.col("n").alias("total")), "key")
            .select("key", "tokens", "label", "n", (F.col("n") / F.col("total")).alias("confidence"), F.size("tokens").alias("size")))
    sets = scratch.write(sets, "led")
    kept = _needed(sets, scratch).filter(F.col("confidence") >= settings.confidence)
    order = kept.withColumns({"_c": -F.col("confidence"), "_n": -F.col("n"), "_s": -F.col("size"), "_one": F.lit(1)})
    ranked = running_sums(order, scratch, "strength", [], ["_c", "_n", "_s", "key", "label"], rule_id="_one")
    return scratch.write(ranked.select((F.col("rule_id") + 1).cast("int").alias("rule_id"), "tokens", "label", "confidence", "n"), "rules")


def _needed(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets (key, tokens, label, n, confidence, size) of which no part gives the label with the same or a higher confidence.

    Level by level of size: the best confidence inside a set is its own or the best inside one of the sets with one token
    less, which are frequent as well. A level is one join on (set, label), linear in sets times tokens.
    """
    longest = sets.agg(F.max("size")).first()[0] or 0
    below, kept = None, None
    for size in range(1, longest + 1):
        level = sets.filter(F.col("size") == size)
        if below is None:
            level = level.withColumn("part", F.lit(-1.0))
        else:
            part = F.array_join(F.filter("tokens", lambda x: x != F.col("gone")), " ")
            parts = level.select("key", "label", F.explode("tokens").alias("gone"), "tokens").select("key", "label", part.alias("p_key"))
            inside = parts.join(below, ["p_key", "label"]).groupBy("key", "label").agg(F.max("best").alias("part"))
            level = level.join(inside, ["key", "label"])
        level = scratch.write(level.withColumn("best", F.greatest("confidence", "part")), f"level{size}")
        below = level.select(F.col("key").alias("p_key"), "label", "best")
        needed = level.filter(F.col("part") < F.col("confidence")).select(*sets.columns)
        kept = needed if kept is None else kept.unionByName(needed)
    return sets if kept is None else kept


def strongest_label(urls: DataFrame, rules: DataFrame, scratch: Scratch, tokens_col: str) -> DataFrame:
    """``urls`` with ``mined_label`` and ``mined_rule``: of the rules whose tokens a URL has, the first in strength; else null.

    A token of a rule is in at least ``support`` of the labelled URLs, so their number is bounded by tokens per URL
    over ``support``. URLs are reduced to these tokens first; each distinct combination is matched once.
    """
    index = rules.select("rule_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"), F.col("label"))
    vocabulary = sorted(r["token"] for r in index.select("token").distinct().collect())
    if not vocabulary:
        return urls.withColumns({"mined_label": F.lit(None).cast("string"), "mined_rule": F.lit(None).cast("int")})
    known = F.array(*[F.lit(t) for t in vocabulary])
    profiled = urls.withColumn("_profile", F.array_join(F.array_sort(F.array_intersect(tokens_col, known)), " "))
    profiles = profiled.select("_profile").distinct()
    fired = (profiles.select("_profile", F.explode(F.split("_profile", " ")).alias("token")).join(index, "token")
             .groupBy("_profile", "rule_id", "size", "label").agg(F.count(F.lit(1)).alias("c")).filter("c = size")
             .groupBy("_profile").agg(F.min(F.struct("rule_id", "label")).alias("r"))
             .select(F.col("_profile").alias("_p"), F.col("r.label").alias("mined_label"), F.col("r.rule_id").alias("mined_rule")))
    fired = scratch.write(fired, "fired")  # one row per combination: its size is known before URLs would be shuffled
    return (profiled.join(F.broadcast(fired) if may_broadcast(fired) else fired, F.col("_profile") == F.col("_p"), "left")
            .drop("_profile", "_p"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], settings: Settings = Settings(),
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined_rule) per page.

    ``rules`` are (verdict, ``host/path``) pairs; the longest that fits decides. Where none fits, the mined rules do, and
    where none of them fires the page is allowed. They are mined from the pages that have a label: the list's verdict if
    a rule fits, else the verdict in ``labels`` (id, label) under the page's id. Several labels of one id count as block
    if one of them does.

    Null, empty and odd URLs have no host and no path and fit no rule. Repeated rows are judged each; further columns are
    ignored; empty tables give no rows.
    """
    scratch = Scratch(pages.sparkSession)
    texts = [text for _, text in rules]
    listed = (pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
              .withColumns({"host": host_of("_url"), "path": path_of("_url"), "_tokens": url_tokens("_url")})
              .withColumn("rule", fitting_rule(F.col("host"), F.col("path"), texts))
              .withColumn("_listed", listed_verdict(F.col("rule"), rules)))
    given = labels.select(F.col(labels.columns[0]).alias("_label_id"), F.col(labels.columns[1]).cast("string").alias("_label")) \
        .groupBy("_label_id").agg(F.max("_label").alias("_label"))  # block comes after allow
    labelled = (listed.join(given, F.col("_id") == F.col("_label_id"), "left")
                .select("_url", F.coalesce("_listed", "_label").alias("label")))
    mined = mine_rules(labelled, scratch, settings, "_url")
    judged = strongest_label(listed, mined, scratch, "_tokens")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule",
                         F.coalesce("_listed", "mined_label", F.lit(ALLOW)).alias("verdict"), "mined_rule")
