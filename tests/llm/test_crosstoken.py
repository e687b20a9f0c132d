"""Cross-tokenizer alignment against a plain version; every form of spilling gives the same."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import crosstoken
from tallyforge.llm.queries import op11_cross_tokenizer

FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


def brute(rows):
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    table, free = {}, 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            table[chr(x)] = x
        else:
            table[chr(free)], free = x, free + 1
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for d, t in rows:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [bytes(table[c] for c in a.id_to_token(i)) for i in ia]
        bb = [piece(i) for i in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            docs.append((d, 0, 0, [], []))
            continue
        groups, links, i, j, ea, eb = [], [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(ia) or j < len(ib):
            if ea <= eb:
                ga.append(ia[i])
                ea += len(ba[i])
                i += 1
            else:
                gb.append(ib[j])
                eb += len(bb[j])
                j += 1
            if ea == eb:
                groups.append((ga, gb))
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        counts.update(links)
        docs.append((d, len(ia), len(ib), groups, links))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for d, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, na, nb, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), text))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.withColumns({c: F.lit(1) for c in ("id", "row", "doc", "part", "run", "first", "task", "payload", "groups", "n_a", "pair", "n", "best", "records")})


ODD = [(1, None), (2, ""), (3, " "), (4, "  two  blanks "), (5, "\n\nlines\n\ttabs\r\n"), (6, "a <|endoftext|> b </s> <s> <unk> <0x41>"), (7, "lower ▁ eighth"),
       (8, "Ünï códé 漢字 😀 ‍   ﬁ ²"), (9, "the the the the"), (9, "the the the the"), (None, "nameless text"), (None, None), (10, "don't I'll we've 12345"),
       (11, "x" * 5000), (12, "\x00\x01"), (13, "the cat sat on the mat, the end")]


def random_rows(seed, n=150):
    rnd = random.Random(seed)
    words = ["the", "cat", "sat", "Straße", "naïve", "12", "tokenizer", "alignment", "été", "unbelievable", "\n", "!?", "of"]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"run_records": 50, "block_records": 7, "partitions": 3, "task_records": 40}, {"partitions": 1, "block_records": 1}])
def test_equals_plain_version(spark, settings):
    rows = ODD + random_rows(len(settings))
    out = crosstoken.aligned_documents(frame(spark, rows), crosstoken.Settings(FIRST, SECOND, **settings))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = brute(rows)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert any(not r[1] and r[0] == 7 for r in want) and any(r[5] < r[4] for r in want)


def test_small_steps_of_the_merge():
    rnd = random.Random(1)
    blocks = []
    for run in range(6):
        keys = sorted((rnd.randrange(40) << 32) | rnd.randrange(3) for _ in range(200))
        for _, r, first, _, payload in crosstoken._spill(np.array(keys, np.uint64), np.arange(200), run, crosstoken.Settings("", "", block_records=9, partitions=1)):
            blocks.append({"first": first, "run": r, "payload": payload})
    blocks.sort(key=lambda r: r["first"])
    steps = list(crosstoken._merged(iter(blocks), gather=30))
    flat = [int(k) for s in steps for k in s[0]]
    assert len(steps) > 20 and flat == sorted(flat) and sum(int(t) for s in steps for t in s[2]) == 1200
    assert all(int(x[0][-1]) < int(y[0][0]) for x, y in zip(steps, steps[1:]))  # no pair in two steps


def test_ranks_give_the_tokens_of_the_file():
    encode, _ = crosstoken._first(FIRST)
    own = Tokenizer.from_file(FIRST)
    own.encode_special_tokens = True
    rnd = random.Random(2)
    pool = [chr(i) for i in range(0x250)] * 2 + list(" \n\t'sdt12.  ") * 40 + list("漢字\u2009😀\ua7cb\u1c89\u0870")
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 50))) for _ in range(3000)] + ["x" * 20_000, " " * 3000, "<|endoftext|>", "don't 'S'll"]
    assert encode(texts) == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert any(crosstoken.LATER.search(t) for t in texts) and not all(crosstoken.LATER.search(t) for t in texts)


def test_empty_and_tokenless_tables(spark):
    settings = crosstoken.Settings(FIRST, SECOND)
    assert crosstoken.aligned_documents(frame(spark, ODD).limit(0), settings).count() == 0
    got = crosstoken.aligned_documents(frame(spark, [(1, None), (2, "")]), settings).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_cross_tokenizer(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute(docs)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
