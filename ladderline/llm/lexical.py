"""Ranked lexical search: an inverted index in shards, searched with MaxScore.

A shard is a block of documents, indexed by the task that reads them: one row per term, with its
documents (numbers within the shard, ascending) and counts, and one row for the documents themselves.
Nothing is shuffled to build it.

A search joins the postings of the queries' terms with the queries, a block of them at a time, and
each shard answers for itself. Per query the lists are taken by falling upper bound (the largest part
of a score that the list has in this shard). While the bounds of what is left can still lift an unseen
document to the tenth best score so far, the next list is essential and all its documents are scored.
From then on lists are non-essential: they are probed only for documents that can still qualify with
what is left. Documents that could tie stay in, so results are exact; the shards' best are merged.

Cases: a null or empty text has no term, isn't counted and is never found; an item without a term, or
without one that any document has, has no result; rows that share a doc_id are documents of their own;
a null doc_id ranks after others of its score; items that share an item_id are ranked each by itself,
once for equal texts; texts of any length are read in pieces; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import in_small_batches, one_of_each, stored, table, with_row_ids

SHARD_BYTES = 16 << 20
#: Text that is split into words at once.
PIECE_BYTES = 4 << 20
#: Queries that a shard answers in one task.
BLOCK_ITEMS = 1000
#: Most terms that are sent to the tasks that build an index for given queries; beyond, all are indexed.
MOST_TERMS = 200_000

#: Bytes of terms (digits, letters and all beyond ASCII) as they are, A-Z lowered; others as a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = "shard long, term binary, at array<int>, tf array<int>, ids array<long>, lengths array<long>"


def terms(text: Column) -> Column:
    """The terms of a text, in order; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERMS), F.lit(0))


class _Shard:
    """Counts words of documents piece by piece, in memory that grows with distinct (term, document)."""

    def __init__(self, only: pa.Array | None, piece_bytes: int):
        self.only, self.piece, self.ids, self.lengths, self.parts = only, piece_bytes, [], [], []
        self.words: list[bytes] = []
        self.runs: list[tuple[int, int]] = []
        self.size = self.pending = 0

    def add(self, doc_id: int | None, text: memoryview) -> None:
        n, at = 0, 0
        while at < len(text):
            end = min(at + self.piece, len(text))
            piece = bytes(text[at:end]).translate(_FOLD)
            if end < len(text):  # a term that the end cuts is left to the next piece
                cut = piece.rfind(b" ") + 1
                while not cut:  # one term longer than a piece
                    end = min(end + self.piece, len(text))
                    piece = bytes(text[at:end]).translate(_FOLD)
                    cut = piece.rfind(b" ") + 1 if end < len(text) else len(piece)
                piece, end = piece[:cut], at + cut
            found = piece.split()
            if found:
                self.words += found
                self.runs.append((len(self.ids), len(found)))
                n += len(found)
            self.pending += end - at
            self.size += end - at
            at = end
            if self.pending >= self.piece:
                self.fold()
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)

    def fold(self) -> None:
        """What is pending becomes counts."""
        if self.words:
            w = pa.array(self.words, pa.binary()).dictionary_encode()
            doc = np.repeat([r[0] for r in self.runs], [r[1] for r in self.runs])
            code = w.indices.to_numpy().astype(np.int64)
            if self.only is not None:
                keep = pc.is_in(w.dictionary, value_set=self.only).to_numpy(zero_copy_only=False)[code]
                doc, code = doc[keep], code[keep]
            key, count = np.unique(code << 32 | doc, return_counts=True)
            used, code = np.unique(key >> 32, return_inverse=True)
            self.parts.append((w.dictionary.take(pa.array(used)), code, key & 0xFFFFFFFF, count))
        self.words, self.runs, self.pending = [], [], 0

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        self.fold()
        names = [f.split()[0] for f in INDEX.split(", ")]
        if not self.ids:
            return
        ints = lambda a, t: pa.array([a], pa.list_(t))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.nulls(1, pa.binary()), ints([], pa.int32()), ints([], pa.int32()), ints(self.ids, pa.int64()), ints(self.lengths, pa.int64())], names=names
        )
        if not sum(len(p[1]) for p in self.parts):
            return
        every = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()  # the parts' terms as one list
        same, base = every.indices.to_numpy().astype(np.int64), np.cumsum([0, *[len(p[0]) for p in self.parts]])
        key = np.concatenate([same[b + p[1]] << 32 | p[2] for b, p in zip(base.tolist(), self.parts)])
        count = np.concatenate([p[3] for p in self.parts])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf, key = np.add.reduceat(count, first), key[first]
        term = key >> 32
        begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        ends = np.append(begin, len(key)).astype(np.int32)
        at, tf = pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(tf.astype(np.int32))
        n = len(begin)
        lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (at, tf)]
        none = pa.nulls(n, pa.list_(pa.int64()))
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), every.dictionary.take(pa.array(term[begin])), *lists, none, none], names=names)
        for i in range(0, n, 10_000):
            yield rows.slice(i, 10_000)


def indexed(docs: DataFrame, shard_bytes: int = SHARD_BYTES, only: list[bytes] | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text), in the shared folder. ``only``: the terms whose postings are kept."""
    vocabulary = None if only is None else pa.array(only, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard(vocabulary, piece_bytes)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard.add(doc_id, memoryview(text.as_buffer()))
                if shard.size >= shard_bytes:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard(vocabulary, piece_bytes)
        yield from shard.rows(number)

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return stored(in_small_batches(rows).mapInArrow(run, INDEX), "lexical-index")


def _best(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) that hold the k best of a shard with all ties, and how many postings were read.
    ``lists``: (documents, parts of the score), by falling upper bound."""
    left = np.cumsum([0, *[int(part.max()) for _, part in reversed(lists)]])[::-1].tolist()  # bounds of the lists from i on
    score, least, i, read = np.zeros(size, np.int64), 0, 0, 0
    kth = max(size - k, 0)
    while i < len(lists) and left[i] >= least:  # essential: what is left could lift an unseen document to the k best
        at, part = lists[i]
        score[at] += part
        read += len(at)
        i += 1
        least = int(np.partition(score, kth)[kth]) if size >= k else 0
    found = np.flatnonzero(score)
    score = score[found]
    for at, part in lists[i:]:
        able = score + left[i] >= least
        found, score = found[able], score[able]
        place = np.searchsorted(at, found)
        place[place == len(at)] = 0
        hit = at[place] == found
        score[hit] += part[place[hit]]
        read += len(found)
        i += 1
        if len(score) >= k:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
    able = score >= least
    return found[able], score[able], read


def _answers(n_docs: int, n_terms: int, k: int):
    """Of a shard's postings (w, items, at, tf) and documents: the k best documents of every item."""

    def run(postings: pa.Table, documents: pa.Table) -> pa.Table:
        ids, lengths = (documents.column(c).combine_chunks().flatten() for c in ("ids", "lengths"))
        unknown = np.iinfo(np.int64).max
        order = pc.fill_null(ids, unknown).to_numpy()
        m = 25 + 75 * lengths.to_numpy().astype(np.int64) * n_docs // n_terms
        parts, of = [], {}
        w, at, tf, items = (postings.column(c).combine_chunks() for c in ("w", "at", "tf", "items"))
        for i, weight in enumerate(w.to_pylist()):
            docs, count = at[i].values.to_numpy(), tf[i].values.to_numpy().astype(np.int64)
            part = weight * (1_000_000_000 * count // (1000 * count + 8 * m[docs]))
            if int(part.max()) > 0:
                for q in items[i].as_py():
                    of.setdefault(q["item"], []).append((len(parts), q["times"]))
                parts.append((docs, part))
        out = []
        for item, having in of.items():
            lists = sorted(((parts[p][0], parts[p][1] * times) for p, times in having), key=lambda x: -int(x[1].max()))
            found, score, _ = _best(lists, len(order), k)
            top = np.lexsort((order[found], -score))[:k]
            out += [(item, ids[int(d)].as_py(), int(s)) for d, s in zip(found[top], score[top])]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item, doc_id, score: the ``k`` best documents of every item (item, text), ties by doc_id; rank from 1."""
    documents = index.where("term is null").select("shard", "ids", "lengths")
    total = documents.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    blocks = -(-max(items.count(), 1) // block_items)
    asked = items.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode(terms(F.col("text"))).alias("term"))
    asked = asked.groupBy("block", "item", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    postings = index.where("term is not null").select("shard", "term", "at", "tf")
    known = asked.select("term").distinct()
    n, length = total["n"] or 0, total["l"] or 0
    df = postings.join(known, "term", "left_semi").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    wanted = asked.join(df, "term").groupBy("term", "block", w.alias("w")).agg(F.collect_list(F.struct("item", "times")).alias("items"))
    left = postings.join(stored(wanted, "query-terms"), "term").select("shard", "block", "w", "items", "at", "tf")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("of_block")
    right = documents.select(F.col("shard").alias("of_shard"), "ids", "lengths", every)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("of_shard", "of_block"))
    found = found.applyInArrow(_answers(n, max(length, 1), k), "item long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).alias("rank")
    return found.select("item", rank, "doc_id", "score").where(F.col("rank") <= k)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, block_items: int = BLOCK_ITEMS, piece_bytes: int = PIECE_BYTES, most_terms: int = MOST_TERMS
) -> DataFrame:
    """item_id, rank, doc_id, score: ``docs`` indexed for the terms of ``items`` and searched once."""
    asked = one_of_each(with_row_ids(items, id_="item_id")).select(F.col("id").alias("item"), F.col("row")["item_id"].alias("item_id"), F.col("row")["text"].alias("text"))
    asked = stored(asked, "items")
    words = asked.select(F.explode(terms(F.col("text"))).alias("t")).distinct().limit(most_terms + 1).collect()
    only = [r["t"].encode() for r in words] if len(words) <= most_terms else None
    found = search(indexed(docs, shard_bytes, only, piece_bytes), asked, k, block_items)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB SQL with the same result as :func:`op11_lexical_search`, by scoring every document.
ORACLE = r"""WITH q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark),
 qt AS (SELECT item_id, term, count(*) times FROM q GROUP BY ALL),
 e AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM documents),
 p AS (SELECT doc_id, term, count(*) tf FROM e GROUP BY ALL),
 n AS (SELECT doc_id, sum(tf)::BIGINT n FROM p GROUP BY ALL),
 s AS (SELECT count(*) docs, sum(n)::BIGINT words FROM n),
 m AS (SELECT doc_id, 25 + (75 * n * docs) // words m FROM n, s),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT w FROM (SELECT term, count(*) df FROM p GROUP BY ALL), s),
 sc AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score FROM qt JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
 r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT rank, doc_id, score FROM sc WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
