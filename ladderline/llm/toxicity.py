"""Toxicity by weak supervision.

1. Voters. From a sample of labelled documents, words and word stems that are much likelier in one
   class become its lexicon voters: each votes where it comes, and abstains elsewhere. Pattern voters
   look at shape: shouting, exclamation marks, symbol noise, and whether no toxic lexicon voter spoke.
2. Label model. A generative model holds, for each voter, how likely it votes given either class.
   Expectation maximisation fits it to the votes of labelled and unlabelled documents. A given label is
   one more voter, silent where there is none, whose errors are estimated like the others'. In every
   round, voters that agree beyond what the classes explain are found to be correlated, and each one's
   evidence is divided by how many such companions it has.
3. Classifier. A logistic regression over hashed words and stems, fitted with an elastic net to the
   label model's posteriors, scores every document.

Samples are bounded: ``per_class`` labelled documents of each class and as many unlabelled ones, by a
hash of doc_id. Labels reach neither votes nor scores but through what is fitted.

Cases: null and empty texts get the score of no evidence; rows with a null doc_id are scored, not
learned from; labels that are null don't count, and of a doc_id's differing labels toxic wins;
repeated rows are scored one by one; without labels of both classes every score is 0; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import held_out, in_small_batches, stored, table
from ladderline.llm.hashing import mixed, slices
from ladderline.llm.langid import code_points
from ladderline.llm.linear import Ftrl

STEMS = (4, 5, 6)
PER_CLASS = 1000
#: A given label is held at so small an error by as many documents as this for each class.
LABEL_ERROR, LABEL_WEIGHT = 0.05, 10.0
#: Least likelihood-ratio statistic of a feature that the classifier looks at.
LEAST_G = 16.0
#: Features (sorted hashes), their weights, bias.
Model = tuple[np.ndarray, np.ndarray, float]
SEED = 13


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its words and of their first 4, 5 and 6 letters."""
    c, counts = code_points(texts.to_pylist())
    letter = c != 32
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    first = np.flatnonzero(begin)
    at = np.flatnonzero(letter)
    where = np.searchsorted(at, first)
    length = np.diff(np.append(where, len(at)))
    depth = np.arange(len(at)) - np.repeat(where, length)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max(initial=1)), np.uint64(0x9E3779B97F4A7C15))), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(c[at].astype(np.uint64) * power[depth], dtype=np.uint64))

    def hashed(take: np.ndarray, kind: int) -> np.ndarray:
        h = mixed((sums[where + take] - sums[where]) ^ (np.uint64(kind) << np.uint64(56)))
        return (h >> np.uint64(1)).view(np.int64)

    kinds = [(hashed(length, 1), None)] + [(hashed(np.minimum(length, n), n), length >= n) for n in STEMS]
    bounds = np.searchsorted(first, np.append(0, np.cumsum(counts)))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(np.concatenate([h[s:e] if ok is None else h[s:e][ok[s:e]] for h, ok in kinds]))


def shapes(texts: pa.Array) -> np.ndarray:
    """Votes of the pattern voters: shouting, exclamation, symbols."""
    out = np.zeros((len(texts), 3), bool)
    for i, t in enumerate(texts.to_pylist()):
        n = max(len(t or ""), 1)
        letters = sum(map(str.isalpha, t or ""))
        out[i] = (
            letters >= 20 and sum(map(str.isupper, t)) > 0.5 * letters,
            n >= 20 and t.count("!") > 0.02 * n,
            n >= 20 and sum(t.count(x) for x in "#$%&*") > 0.05 * n,
        )
    return out


@dataclass
class LabelModel:
    """P(vote | class) of each voter (rows: clean, toxic), what part of its evidence counts, and
    P(label says toxic | class)."""

    prior: float
    rate: np.ndarray
    weight: np.ndarray
    told: np.ndarray

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """P(toxic | votes, label); a label of -1, or none, says nothing."""
        on = np.log(self.rate[1] / self.rate[0]) * self.weight
        off = np.log((1 - self.rate[1]) / (1 - self.rate[0])) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        if label is not None:
            yes, no = np.log(self.told[1] / self.told[0]), np.log((1 - self.told[1]) / (1 - self.told[0]))
            z = z + np.where(label == 1, yes, np.where(label == 0, no, 0.0))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _evidence(votes: np.ndarray, q: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """For each voter one over how many, itself included, it agrees with beyond what the classes explain."""
    rest = votes - (1 - q)[:, None] * rate[0] - q[:, None] * rate[1]
    spread = np.sqrt((rest**2).mean(0)) + 1e-9
    alike = np.abs(rest.T @ rest) / len(votes) / np.outer(spread, spread)
    return 1 / np.maximum((alike * (alike > 0.3)).sum(0), 1.0)


def fit_label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 10) -> tuple[LabelModel, np.ndarray]:
    """votes: documents x voters, 0 or 1. label: 0, 1, or -1 (unknown). The model and its posteriors."""
    known, votes = label >= 0, votes.astype(float)
    q = np.where(known, np.clip(label, 0.1, 0.9), label[known].mean())
    weight = np.ones(votes.shape[1])
    for r in range(rounds):
        mass = np.stack([1 - q, q])
        # rates are held a little away from 0 and 1, the clean ones the more
        rate = (mass @ votes + np.array([[0.01], [0.05]])) / (mass.sum(1, keepdims=True) + 0.1)
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        of = mass[:, known]
        told = of @ label[known] + LABEL_WEIGHT * np.array([LABEL_ERROR, 1 - LABEL_ERROR])
        told = np.clip(told / (of.sum(1) + LABEL_WEIGHT), 1e-3, 1 - 1e-3)
        if r:  # the first round has no classes but the labels'
            weight = _evidence(votes, q, rate)
        model = LabelModel(float(np.clip(q.mean(), 1e-3, 0.999)), rate, weight, told)
        q = model.posterior(votes, label)
    return model, q


def _gathered(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                found = pa.array(list(features(texts)), pa.list_(pa.int64()))
                votes = pa.array(shapes(texts).tolist(), pa.list_(pa.bool_()))
                own = [b.column(c).slice(at, len(texts)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([own[0], found, votes, own[1]], names=["label", "at", "shape", "place"])
                at += len(texts)

    some = docs.select("label", "text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("place"))
    return some.mapInArrow(run, "label int, at array<long>, shape array<boolean>, place long")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Model | None:
    """Features, weights and bias from the rows of ``docs`` that may be learned from."""
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    ids = docs.select("doc_id").join(label, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"))
    ids = stored(ids, "label-ids")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}  # three rows
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.lit(0.0)
    for x, n in counts.items():
        share = F.when(F.col("label") == x, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000).distinct()
    rows = _gathered(docs.join(F.broadcast(chosen), "doc_id")).toArrow()  # at most 3 x per_class rows, or so
    rows = rows.sort_by("place")  # however the rows were dealt
    y = rows["label"].to_numpy()
    if not ((y == 0).any() and (y == 1).any()):
        return None
    lists = rows["at"].combine_chunks()
    shape = np.array(rows["shape"].to_pylist(), float)
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    keys, which, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    often = times >= 3  # no rarer feature can tell the classes apart
    keys, which, owner = keys[often], (np.cumsum(often) - 1)[which][often[which]], owner[often[which]]
    df = [np.bincount(which[y[owner] == c], minlength=len(keys)) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    # lexicon voters: much likelier in documents of one class than in the other's
    p1, p0 = (df[1] + 0.1) / (n[1] + 0.2), (df[0] + 0.1) / (n[0] + 0.2)
    # "g": the shares in both classes differ by more than chance makes of that many features
    mean = np.maximum((df[0] + df[1]) / (n[0] + n[1]), 1e-12)
    g = sum(2 * d * np.log(np.maximum(d, 1e-9) / (m * mean)) for d, m in zip(df, n) if m)
    toxic = np.flatnonzero((g > LEAST_G) & (p1 > 8 * p0))
    voters = np.append(toxic, np.flatnonzero((g > LEAST_G) & (p0 > 8 * p1)))  # no more than the sample has features
    place = np.full(len(keys), -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(y), len(voters) + 4))
    hit = place[which] >= 0
    votes[owner[hit], place[which][hit]] = 1
    votes[:, len(voters) : len(voters) + 3] = shape
    votes[:, -1] = ~votes[:, : len(toxic)].any(axis=1)
    _, posterior = fit_label_model(votes, y)
    useful = np.flatnonzero(g > LEAST_G)
    slot = np.full(len(keys), -1)
    slot[useful] = np.arange(len(useful))
    model = Ftrl(len(useful), 2, alpha=0.3, beta=1.0, l1=1.0, l2=0.05)
    at = slot[which]
    cuts = np.searchsorted(owner, np.arange(1, len(y)))
    data = [(x := a[a >= 0], np.ones(len(x))) for a in np.split(at, cuts)]
    w = model.fit(data, np.stack([1 - posterior, posterior], 1), epochs=4, seed=seed)
    d = w[:, 1] - w[:, 0]
    # the sample holds the classes in other shares than the corpus: scores are fitted to its labels,
    # each with the weight of the rows that it stands for
    z, known = np.array([d[x].sum() for x, _ in data]) + d[-1], y >= 0
    weight = np.array([counts[c] / n[c] for c in y[known]])
    a, b = _platt(z[known], y[known], weight)
    some = np.flatnonzero(d[:-1])
    return keys[useful][some], a * d[:-1][some], float(a * d[-1] + b)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Scale and shift of z with the least weighted log loss (Newton steps, lightly held to 1 and 0)."""
    x, t = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        slope = x.T @ (weight * (p - y)) + (t - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        t = t - np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
        t[0] = np.clip(t[0], 0.2, 3.0)
    return (float(t[0]), float(t[1])) if np.isfinite(t).all() else (1.0, 0.0)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every document. The model has no more features than its sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model or (np.zeros(0, np.int64), np.zeros(0), -40.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias = shared.value
        keys, weights = np.append(keys, np.iinfo(np.int64).max), np.append(weights, 0.0)
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                z = np.full(len(texts), bias)
                for i, f in enumerate(features(texts)):
                    k = np.searchsorted(keys, f)
                    z[i] += weights[k[keys[k] == f]].sum()
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(p)], names=["doc_id", "score"])
                at += len(texts)

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    scored = score(docs, fit(learn, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
