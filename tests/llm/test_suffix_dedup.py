"""Repeats of 50 bytes against all windows, and deep-shallow sorting against Python's."""

import hashlib
import random

import numpy as np
import pytest

from ladderline.llm import common, deep_shallow, suffix_dedup
from ladderline.llm.common import one_of_each

DOCS = "doc_id long, text string, id long, start long, kept string"  # with names that the operator uses itself


def plain(docs, width=50):
    raw = [(i, (t or "").encode()) for i, t in docs]
    owner = {}
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - width + 1):
                w = b[p : p + width]
                owner[w] = min(owner.get(w, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - width + 1):
                if owner[b[p : p + width]] < i:
                    gone[p : p + width] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, docs = [say(n) for n in (40, 47, 50, 51, 80, 300)], []
    for i in range(120):
        docs.append((i, "".join(rng.choice([say(rng.randint(0, 60)), rng.choice(shared)]) for _ in range(rng.randint(0, 5)))))
    docs += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 51), (205, "x" * 4000), (206, "ab" * 900), (207, "ba" * 30), (208, "ü" * 25)]
    docs += [(None, shared[5]), (3, shared[5]), (3, shared[5]), (300, shared[5] + shared[5])] + [(i, docs[5][1] + shared[5]) for i in range(400, 420)]
    docs += [(500, say(6000)), (501, None)]
    return docs[:-1] + [(501, docs[-2][1][1000:5000] + "!" + docs[-2][1][:3000])]


@pytest.mark.parametrize(("most", "piece", "sort_most", "stretch"), [(2000, 1 << 20, 1 << 20, 1 << 22), (1, 100, 1 << 20, 300), (2000, 1000, 10, 1)])
def test_equals_all_windows(spark, corpus, most, piece, sort_most, stretch):
    rows = suffix_dedup.with_ids(spark.createDataFrame([(*r, 1, 2, "x") for r in corpus], DOCS).repartition(4))
    spans = suffix_dedup.duplicate_spans(one_of_each(rows), classes_most=most, piece_bytes=piece, sort_most=sort_most, stretch_bytes=stretch)
    got = sorted(((r.doc, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.without_spans(rows, spans).collect()), key=repr)
    assert got == plain(corpus)


def test_other_widths_and_no_rows(spark, corpus):
    docs = spark.createDataFrame(corpus[:40], "doc_id long, text string")
    rows = suffix_dedup.with_ids(docs)
    spans = suffix_dedup.duplicate_spans(rows, width=21, gram=21)
    got = sorted(((r.doc, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.without_spans(rows, spans).collect()), key=repr)
    assert got == plain(corpus[:40], 21)
    none = suffix_dedup.with_ids(docs.limit(0))
    assert suffix_dedup.without_spans(none, suffix_dedup.duplicate_spans(none)).collect() == []


def test_the_disk_holds_one_slice_of_grams(spark, corpus, monkeypatch):
    made, gone = [], []

    def stored(df, name):
        out = common.stored(df, name)
        if name == "shared-stretches":
            assert len(made) == sum(n == name for n, _ in gone)  # the slice before went with all that was made for it
            made.append(out.count())
        names[tuple(out.inputFiles())] = name
        return out

    def discarded(*tables):
        gone.extend((names[tuple(df.inputFiles())], df) for df in tables)
        common.discarded(*tables)

    names = {}
    monkeypatch.setattr(suffix_dedup, "stored", stored)
    monkeypatch.setattr(suffix_dedup, "discarded", discarded)
    rows = suffix_dedup.with_ids(spark.createDataFrame(corpus, "doc_id long, text string"))
    spans = suffix_dedup.duplicate_spans(one_of_each(rows), sliced_from=1)
    got = sorted(((r.doc, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.without_spans(rows, spans).collect()), key=repr)
    assert got == plain(corpus)
    assert len(made) > 1 and max(made) < 0.75 * sum(made)
    assert {"shared-stretches", "each-class", "classes", "strings", "owners", "gone", "shared-grams"} <= {n for n, _ in gone}


def test_more_slices_where_more_is_shared():
    of = [suffix_dedup.slices_for(10**10, n) for n in (0, 10**8, 3 * 10**8, 6 * 10**8)]
    assert of == sorted(of) and of[0] == 1 and of[-1] > 3
    assert suffix_dedup.slices_for(1000, 60) == 1


@pytest.mark.parametrize(("seed", "depth", "shallow"), [(s, d, w) for s in range(4) for d, w in ((50, 16), (50, 24), (9, 16), (13, 5), (30, 0))])
def test_suffixes_are_in_order(seed, depth, shallow):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + [1, 2, 5, 200][seed], 3000).astype(np.uint8)
    text[1500:2000], text[2100:2300] = text[100:600], 97
    starts = rng.permutation(3000 - depth)[:2500]
    order, fresh = deep_shallow.sorted_suffixes(text, starts, depth, shallow)
    raw = text.tobytes()
    keys = [raw[s : s + depth] for s in starts[order].tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(2500))
    assert fresh.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(2500)]


def test_blind_trie():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(6)) for _ in range(500)]
    leaves = deep_shallow.blind_trie_order(strings)
    assert [strings[i] for leaf in leaves for i in leaf] == sorted(strings)
    assert len(leaves) == len(set(strings)) and all(len({strings[i] for i in leaf}) == 1 for leaf in leaves)
