"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams (1 to 3 code points of lowered letters, anything else a space) are hashed into buckets. Term
frequencies are shares of a text's n-grams; document frequencies are counted over all documents that
may be learned from. The model is fitted with FTRL-proximal and an elastic net on a sample of at most
``per_language`` documents per language, whole texts, and its confidence is calibrated by a
temperature on documents of the sample that were held back.

Cases: a null text, and one without a letter, is ``und`` with score 0; rows with a null ``lang`` or
doc_id are not learned from, nor are values of ``lang`` beyond the ``MOST_LANGUAGES`` most frequent;
repeated rows are learned from once and scored one by one; with nothing to learn from every text is ``und``; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import held_out, in_small_batches, table
from ladderline.llm.hashing import slices
from ladderline.llm.linear import Ftrl, softmax, temperature

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
PER_LANGUAGE = 1500
#: Languages that are learned, the most frequent ones: bounds the weights, which every task holds.
MOST_LANGUAGES = 200
SEED = 7


@functools.cache
def _folded() -> np.ndarray:
    """Each code point's lowered letter; a space for what is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each with a space before and after; and how many each has."""
    joined = "".join(f" {t or ''} " for t in texts)
    counts = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    return _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")], counts


def buckets(c: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each code point (the last ones wrap and don't count)."""
    h = c.astype(np.uint64)
    for i in range(1, size):
        h = h * np.uint64(0x100000001B3) + np.roll(c, -i)
    h = (h + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64)


def grams(c: np.ndarray) -> np.ndarray:
    """All buckets of one text; runs of blanks alone don't count."""
    out = []
    for n in SIZES:
        if len(c) >= n:
            b = buckets(c, n)[: len(c) - n + 1]
            blank = np.ones(len(b), bool)
            for i in range(n):
                blank &= c[i : i + len(b)] == 32
            out.append(b[~blank])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket comes, over all of them; a row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        seen = np.zeros(BUCKETS, bool)
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[:] = False
                seen[grams(code_points([t])[0])] = True
                df += seen
                n += 1
        at = np.append(np.flatnonzero(df), BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(df[df > 0], n))], names=["bucket", "n"])

    rows = in_small_batches(docs.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def _sample(docs: DataFrame, most: int, languages: int = MOST_LANGUAGES) -> DataFrame:
    """At most about ``most`` rows of each of the ``languages`` most frequent values of lang, by a hash of the
    row, repeated rows once; so an id or a text that a third of all rows share takes no more room than
    others. A row per language is collected."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["n"])) for r in counts], "lang string, share double")
    place = F.xxhash64(F.lit(SEED), "doc_id", "text", "lang")
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").withColumn("place", place)
    return rows.where(F.pmod("place", F.lit(1_000_000)) < F.col("share") * 1_000_000).dropDuplicates(["place"])


def fit(docs: DataFrame, most: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``docs``: those to learn from, with non-null lang. Languages, weights (with idf and temperature
    put in), bias. The sample is put in order of a hash, so that it doesn't matter how rows are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in b.column(2).to_pylist():
                u, k = np.unique(grams(code_points([t])[0]), return_counts=True)
                at.append(u)
                n.append(k)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (at, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["place", "lang", "at", "n"])

    sample = in_small_batches(_sample(docs, most).select("place", "lang", "text")).mapInArrow(run, "place long, lang string, at array<long>, n array<long>").toPandas()
    sample = sample.sort_values("place", kind="stable").reset_index(drop=True)
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = sample[sample["at"].map(len) > 0]
    langs = sorted(set(sample["lang"]))
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    y = sample["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    rows = []
    for at, n in zip(sample["at"], sample["n"]):
        at, n = np.asarray(at), np.asarray(n, dtype=float)
        rows.append((at, 100 * n / n.sum() * idf[at]))
    back = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~back)
    model = Ftrl(BUCKETS, len(langs), alpha=0.05, beta=1.0, l1=0.05, l2=0.5)
    w = model.fit([rows[k] for k in train], np.eye(len(langs))[y[train]], epochs=3, seed=SEED)
    held = np.flatnonzero(back)
    t = temperature(np.array([x @ w[at] + w[-1] for at, x in (rows[k] for k in held)]), y[held]) if len(held) else 1.0
    return langs, (100 * idf[:, None] * w[:-1] / t).astype(np.float32), w[-1] / t


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every document. The model has a fixed number of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w, bias = shared.value
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                c, counts = code_points(texts.to_pylist())
                ends = np.cumsum(counts)
                begins = ends - counts
                letters = np.add.reduceat(c != 32, begins)
                z, n = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
                for size in SIZES:
                    good = c != 32
                    for i in range(1, size):
                        good |= np.roll(c, -i) != 32
                    for i in range(1, size):
                        good[ends - i] = False  # it would reach into the next text
                    k = buckets(c, size)
                    n += np.add.reduceat(good, begins)
                    for x in range(len(langs)):
                        z[:, x] += np.add.reduceat(np.where(good, w[k, x], np.float32(0)), begins, dtype=np.float64)
                p = softmax(z / np.maximum(n, 1)[:, None] + bias) if langs else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                und = (letters == 0) | (not langs)
                names = np.array([*langs, "und"], object)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)),
                        pa.array(names[np.where(und, len(langs), best)], pa.string()),
                        pa.array(np.where(und, 0.0, p.max(axis=1))),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )
                at += len(texts)

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return predict(docs, fit(learn)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
