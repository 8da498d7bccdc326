"""Ranked search against scoring every document, over several shards and blocks of queries."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, rank int, score long"  # with names that the result has too


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counts = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, total = len(counts), sum(len(t) for _, t in counts)
    df = {}
    for _, t in counts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in counts:
            m = 25 + 75 * len(t) * n // total
            parts = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms(text) if x in df]
            if sum(parts) > 0:
                scored.append((-sum(parts), i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcé7") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    say = lambda n: "".join(rng.choice(vocabulary[: rng.choice([10, 150])]) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, say(rng.randint(1, 80))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, "?! -"), (None, say(20)), (None, "ABC abc Abc"), (7, "rows that share an id " + say(9)), (7, "rows that share an id " + say(9))]
    docs += [(i, "the same text a b c") for i in range(600, 630)] + [(700, say(20_000)), (701, "Z" * 5000 + " " + "zq" * 3000)]
    items = [(f"q{i}", say(rng.randint(1, 12))) for i in range(40)]
    items += [("none", None), ("empty", ""), ("nothing", "unheardof"), ("same", "the SAME text, text"), ("long", "z" * 5000), (None, "share an id")]
    return docs, items


@pytest.mark.parametrize(("shard", "block", "most", "piece"), [(1 << 24, 1000, 200_000, 1 << 22), (2000, 7, 200_000, 64), (9000, 1, 3, 700)])
def test_equals_scoring_all(spark, corpus, shard, block, most, piece):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*i, 5) for i in items], "item_id string, text string, doc_id long")
    numbered = q.withColumn("item_id", F.when(F.col("item_id").isNotNull(), F.hash("item_id").cast("long")))
    of = {r[0]: r[1] for r in q.select("item_id", F.hash("item_id").cast("long")).collect() if r[0]}
    got = sorted(map(tuple, lexical.ranked(d, numbered, shard_bytes=shard, block_items=block, piece_bytes=piece, most_terms=most).collect()), key=repr)
    assert got == sorted(((of.get(i), r, doc, s) for i, r, doc, s in plain(docs, items)), key=repr)


def test_items_that_share_an_id_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, "d")], "item_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id) for r in lexical.ranked(docs, items).collect())
    assert got == [(1, 1, 1), (1, 1, 2)]
    assert lexical.ranked(docs.limit(0), items).collect() == [] == lexical.ranked(docs, items.limit(0)).collect()


def test_non_essential_lists_are_only_probed():
    rng = np.random.default_rng(2)
    size = 20_000
    rare, common = np.sort(rng.choice(size, 60, replace=False)), np.arange(size)
    lists = [(rare, np.full(60, 10**6)), (common, rng.integers(1, 100, size))]
    found, score, read = lexical._best(lists, size, 10)
    full = np.zeros(size, np.int64)
    for at, part in lists:
        full[at] += part
    tenth = np.sort(full)[-10]
    assert set(found) == set(np.flatnonzero(full >= tenth)) and (full[found] == score).all()
    assert read <= 120  # the common list is read for the rare one's documents, not for all 20,000


@pytest.mark.parametrize("seed", range(30))
def test_best_of_a_shard_with_ties(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 60))
    lists = []
    for _ in range(int(rng.integers(1, 7))):
        at = np.flatnonzero(rng.random(size) < rng.random())
        if len(at):
            lists.append((at, rng.integers(0, 4, len(at)) * int(rng.integers(1, 5)) + 1))
    lists.sort(key=lambda x: -x[1].max())
    full = np.zeros(size, np.int64)
    for at, part in lists:
        full[at] += part
    found, score, _ = lexical._best(lists, size, 5)
    best = sorted((-int(s), i) for i, s in enumerate(full) if s)[:5]
    assert sorted((-int(s), int(i)) for i, s in zip(found, score))[:5] == best
