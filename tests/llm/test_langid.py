"""Language identification: what is sampled from dirty tables, and the features against plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import langid


def test_a_sample_of_rows_not_of_ids(spark):
    rng = random.Random(1)
    rows = [(5, f"text {i}", "en") for i in range(3000)] + [(i, "the same", "de") for i in [7] * 2000] + [(i, f"t{i}", rng.choice(["fr", "en"])) for i in range(100, 1100)]
    rows += [(9000 + i, "x", f"odd{i}") for i in range(2000)]  # a dirty column
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid._sample(docs, 200, 3).groupBy("lang").agg(F.count("*").alias("n")).collect()
    n = {r.lang: r.n for r in got}
    assert set(n) <= {"en", "de", "fr"} and 120 < n["en"] < 290 and n.get("de", 1) <= 1 and 120 < n["fr"] < 290
    again = langid._sample(docs.repartition(3), 200, 3)
    assert sorted(r.place for r in again.collect()) == sorted(r.place for r in langid._sample(docs, 200, 3).collect())


def test_two_thousand_languages_do_not_fail(spark):
    rng = random.Random(2)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, say("abcde" if i % 2 else "uvwxy", 20), "low" if i % 2 else "high") for i in range(200)] + [(1000 + i, say("mnop", 3), f"odd{i:04d}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, weights, _ = langid.fit(docs, 50)
    assert len(langs) <= langid.MOST_LANGUAGES and {"low", "high"} <= set(langs) and weights.shape == (langid.BUCKETS, len(langs))


def plain_grams(text):
    """How often each run of 1 to 3 folded code points comes that isn't all blank."""
    c = [x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in f" {text} "]
    out = {}
    for size in langid.SIZES:
        for i in range(len(c) - size + 1):
            gram = "".join(c[i : i + size])
            if gram.strip(" "):
                out[gram] = out.get(gram, 0) + 1
    return out


def test_grams_are_those_of_the_text():
    rng, bucket_of = random.Random(3), {}
    for _ in range(60):
        text = "".join(rng.choice("aB é.\n7ßЖ") for _ in range(rng.randint(0, 30)))
        want = plain_grams(text)
        got = dict(zip(*(x.tolist() for x in np.unique(langid.grams(langid.code_points([text])[0]), return_counts=True))))
        for gram in want:
            if gram not in bucket_of:  # an n-gram alone tells its bucket: of all runs in it, the one that has all of it
                alone = langid.buckets(langid.code_points([gram])[0][1:-1], len(gram))[0]
                bucket_of[gram] = int(alone)
        made = {}
        for gram, n in want.items():
            made[bucket_of[gram]] = made.get(bucket_of[gram], 0) + n
        assert got == made


def test_document_frequencies_against_plain_counts(spark):
    texts = ["ab ab", "b c", "", "ab", "Ab"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    df, n = langid.document_frequencies(docs)
    want = {}
    for t in texts:
        for b in set(langid.grams(langid.code_points([t])[0]).tolist()):
            want[b] = want.get(b, 0) + 1
    assert n == 5 and {int(i): int(df[i]) for i in np.flatnonzero(df)} == want


def test_ftrl_steps_against_plain_python():
    """Per-coordinate FTRL-proximal with an elastic net, written out for one example after another."""
    from ladderline.llm.linear import Ftrl, softmax

    rng = np.random.default_rng(4)
    size, classes, alpha, beta, l1, l2 = 6, 3, 0.3, 1.0, 0.05, 0.1
    data = [(np.sort(rng.choice(size, 3, replace=False)), rng.random(3)) for _ in range(12)]
    target = np.eye(classes)[rng.integers(0, classes, 12)]
    got = Ftrl(size, classes, alpha=alpha, beta=beta, l1=l1, l2=l2).fit(data, target, epochs=2, seed=9)
    z, n = [[0.0] * classes for _ in range(size + 1)], [[0.0] * classes for _ in range(size + 1)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(9)
    for _ in range(2):
        for k in order.permutation(12):
            x = {**dict(zip(data[k][0].tolist(), data[k][1].tolist())), size: 1.0}
            score = [sum(v * weight(i, c) for i, v in x.items()) for c in range(classes)]
            total = sum(math.exp(s) for s in score)
            step = {(i, c): v * (math.exp(score[c]) / total - target[k][c]) for i, v in x.items() for c in range(classes)}
            now = {(i, c): weight(i, c) for i, c in step}
            for (i, c), g in step.items():
                z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha * now[i, c]
                n[i][c] += g * g
    assert got == pytest.approx(np.array([[weight(i, c) for c in range(classes)] for i in range(size + 1)]))
    assert softmax(np.array([[0.0, math.log(3)]]))[0] == pytest.approx([0.25, 0.75])


def test_prediction_against_plain_python(spark):
    rng = random.Random(5)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, say("abcdeé" if i % 2 else "uvwxy", 12), "low" if i % 2 else "high") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    langs, weights, bias = langid.fit(learn)
    assert langs == ["high", "low"]
    right = 0
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 == 2:
            at, k = np.unique(langid.grams(langid.code_points([text])[0]), return_counts=True)
            tf = k / k.sum()
            score = np.array([sum(t * weights[b, c] for t, b in zip(tf, at)) for c in range(2)]) + bias
            right += langs[int(np.argmax(score))] == lang
    assert right == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows)
