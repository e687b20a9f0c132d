"""Line dedup against a plain version, and its edge cases."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import linededup
from tallyforge.llm.linededup import Settings

LONG = "this line is long enough to be a key of at least forty code points"


def brute(rows, least_chars=40, least_docs=5):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(d)
    repeated = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in repeated or repeated[key(x)] == d]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("doc", "row", "key", "pos", "line", "keeper", "n_docs", "n_lines", "n_dropped", "gone", "_doc", "_row")})


def check(spark, rows, settings=Settings()):
    got = linededup.drop_repeated_lines(frame(spark, rows), settings)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, settings.least_chars, settings.least_docs)


def random_rows(seed, n=120):
    rnd = random.Random(seed)
    pool = [f"{LONG} {i}" for i in range(25)] + ["", " ", "short", "x" * 39, "y" * 40, "é" * 40]
    dress = lambda s: rnd.choice(["", " ", "\t", "\x0b"]) + rnd.choice([s, s.upper(), s]) + rnd.choice(["", "\r", "  "])
    return [(rnd.randrange(90), "\n".join(dress(rnd.choice(pool)) for _ in range(rnd.randint(0, 12)))) for _ in range(n)]


def edge_rows():
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n" + LONG + "\n"), (5, LONG + "\n" + LONG), (6, LONG.upper() + "\r"), (7, "\t" + LONG), (8, "a\n" + LONG),
            (9, LONG), (9, LONG), (9, LONG + "\nother"), (None, LONG + "\nnameless"), (None, LONG), (10, " " + LONG), (11, LONG[:39]), (12, None)]
    return rows + [(20, "\n".join([LONG, "z" * 50, "q"] * 20_000)), *[(21 + i, "z" * 50) for i in range(4)]]


def test_random(spark):
    for seed in (1, 2):
        check(spark, random_rows(seed))
    check(spark, random_rows(3), Settings(least_chars=1, least_docs=2))


def test_edges(spark):
    check(spark, edge_rows())
    check(spark, edge_rows(), Settings(least_docs=1))


def test_joined_by_key_and_hot_keys_apart(tight):
    check(tight, random_rows(4), Settings(hot_docs=12))
    check(tight, edge_rows(), Settings(hot_docs=3))


def test_empty_table(spark):
    assert linededup.drop_repeated_lines(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_repeated_keys(spark):
    got = linededup.repeated_keys(frame(spark, [(i, LONG) for i in range(7)] + [(None, LONG), (1, "other")])).collect()
    assert [(r["n_docs"], r["keeper"]) for r in got] == [(8, 6)]
