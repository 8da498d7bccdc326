"""Fuzzy passages: what must not be glued together, what must be found, how far an end goes."""

import random

import pytest

from ladderline.llm import substring_dedup as sd


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def edited(rng, passage, similarity):
    """``passage`` with as many words changed, left out or put in, at random places, as ``similarity`` lets."""
    out = list(passage)
    for at in sorted(rng.sample(range(len(out)), int(len(out) * (1 - similarity))), reverse=True):
        kind = rng.random()
        if kind < 0.8:
            out[at] = words(rng, 1)[0]
        elif kind < 0.9:
            del out[at]
        else:
            out.insert(at, words(rng, 1)[0])
    return out


def found(spark, docs):
    out = {}
    for r in sd.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_phrases_of_many_documents_are_no_passage(spark):
    rng = random.Random(11)
    earlier = [words(rng, 120) for _ in range(25)]
    quilt = [w for e in earlier[:20] for w in e[40:50]]  # no earlier document holds more than ten of these in a row
    longer = [w for e in earlier[:20] for w in e[10:50]]
    one = [w for k in rng.sample(range(11), 11) for w in earlier[0][10 * k : 10 * k + 10]]  # of one document, out of order
    real = words(rng, 30) + earlier[3][20:100] + earlier[4][20:100] + words(rng, 30)
    docs = [*enumerate(earlier), (100, words(rng, 30) + quilt + words(rng, 30)), (101, longer), (102, words(rng, 20) + one), (103, real)]
    got = found(spark, docs)
    assert sorted(got) == [103]
    assert [(r.start, r.n_words, sorted(r.source_ids)) for r in got[103]] == [(30, 160, [3, 4])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    left = {r.doc_id: len(r.text.split()) for r in sd.remove_passages(df, sd.passages(df)).collect()}
    assert left[100] == 260 and left[101] == 800 and left[103] == 60


def test_passages_with_edits_at_random_places(spark):
    rng, docs, kinds = random.Random(12), [], {}
    for similarity in (0.82, 0.85, 0.9, 1.0):
        for n in (60, 80, 150, 300):
            for _ in range(40):
                passage = words(rng, n)
                i = len(docs)
                copy = edited(rng, passage, similarity)
                docs += [(i, words(rng, 40) + passage + words(rng, 40)), (i + 1, words(rng, 30) + copy + words(rng, 30))]
                kinds[i + 1] = (similarity, n, len(copy))
    got = found(spark, docs)
    assert not [i for i in got if i not in kinds]
    for similarity in (0.82, 0.85, 0.9, 1.0):
        for n in (60, 80, 150, 300):
            of = [i for i, k in kinds.items() if k[:2] == (similarity, n)]
            hit = sum(i in got for i in of) / len(of)
            cover = sum(sum(r.n_words for r in got[i]) / kinds[i][2] for i in of if i in got) / max(sum(i in got for i in of), 1)
            assert hit >= 0.9 or similarity < 0.85, (similarity, n, hit)
            assert 0.85 <= cover <= 1.05, (similarity, n, cover)
            for i in of:  # nothing beyond the copy but a word or two
                assert all(r.start >= 27 and r.start + r.n_words <= 30 + kinds[i][2] + 3 for r in got.get(i, []))


def test_an_end_without_seeds_goes_on(spark):
    rng = random.Random(13)
    passage = words(rng, 260)
    copy = [w if k < 90 or k % 5 else words(rng, 1)[0] for k, w in enumerate(passage)]  # the tail has no five equal words in a row
    got = found(spark, [(1, words(rng, 50) + passage + words(rng, 50)), (2, words(rng, 50) + copy + words(rng, 50))])
    (r,) = got[2]
    assert r.start == 50 and 255 <= r.n_words <= 262


@pytest.mark.parametrize("seed", range(20))
def test_unlike_words_end_an_extension(seed):
    rng = random.Random(seed)
    common = words(rng, 30)
    a, b = ([rng.choice(common) for _ in range(400)] for _ in range(2))  # three words in a hundred agree by chance
    x, y, same = sd._extend(a, b, 10.0)
    assert max(x, y) <= 25
    n = 50
    assert sd._extend(common + a, common + b)[0] >= 30 and sd._extend(a[:n], a[:n]) == (n, n, n)
    assert sd._extend([], b) == (0, 0, 0) == sd._extend(a, [])
