"""Exact repeats of ``width`` bytes across documents, found by sorting suffixes.

Every window of 50 bytes belongs to the smallest hash among the runs of 20 bytes that it holds (its
gram), so equal windows belong to equal grams wherever they stand, and neighbours mostly share theirs:
a stretch is all neighbouring windows of one gram.

1. One scan gives (gram, doc_id); a gram that one document alone has can't hold a repeat. The counts
   combine before the shuffle.
   Steps 2 to 4 then take the other grams in slices by their hash, so that the disk holds one slice at a
   time; there are more slices where more of the text is shared. Only places to cut are kept of a slice.
2. A scan for each slice gives the stretches of its grams, each with a hash of its bytes. Stretches equal
   in gram and hash (two times 64 bits) are one class, with the smallest document that has it.
3. A gram with one class needs no text: its windows belong to that document. Of the other classes one
   stretch each is fetched, some 90 bytes. Classes of a gram come together, and their suffixes are put
   in order by deep-shallow sorting. Where neighbours agree for 50 bytes, the windows are equal; the
   smallest document of such a group owns it. A gram with very many classes isn't sorted in one task:
   its windows are grouped by their bytes.
4. A window goes where its owner has a smaller doc_id. Windows of all slices are merged into spans, spans
   cut out.

A document's text is only ever held by the task that reads it; pieces of a megabyte travel.

Cases: null and empty texts, and texts under 50 bytes, have no window and stay; a null doc_id has no
place in the order: its row stays whole and owns nothing; rows that share a doc_id aren't smaller than
each other and are each judged by themselves; a repeat within one document alone stays; texts of any
length are read in pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import discarded, having, in_small_batches, one_of_each, stored, table, with_row_ids
from ladderline.llm.deep_shallow import sorted_suffixes
from ladderline.llm.hashing import mixed

WIDTH = 50
#: Runs of 16 bytes are shared by chance ever more often as the text grows, and each that is costs a fetch.
GRAM = 20
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 40
PIECE_BYTES = 1 << 20
#: Bytes of text hashed at once.
STRETCH_BYTES = 1 << 18
#: Suffixes sorted at once, unless one gram alone has more.
SORT_MOST = 1 << 20
#: Classes of a gram beyond which its windows are grouped by their bytes instead of sorted in one task.
CLASSES_MOST = 2000
#: Bytes of text from which on grams are taken in slices.
SLICED_FROM = 64 << 20
#: Bytes of disk that a slice may take for each byte of text, and what a stretch takes: shuffled, and if
#: its gram is shared (at most: as a class of its own, with its string stored and shuffled).
SLICE_SHARE, SHUFFLED_BYTES, SHARED_BYTES = 3, 31, 200
#: A gram is the smallest of some hashes, so only its low bits are evenly spread.
_LOW = (1 << 31) - 1

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _doubled(x: np.ndarray, n: int, joined) -> np.ndarray:
    """``joined`` over each n neighbours of x: from pairs, pairs of pairs, ..., and the rest."""
    size, out, have, m = 1, None, 0, len(x) - n + 1
    while True:
        if n & size:
            out = x if out is None else joined(out[: len(x) - have], x[have:], size)
            have += size
        if size * 2 > n:
            return out[:m]
        x = joined(x[:-size], x[size:], size)
        size *= 2


def _appended(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    m = min(len(a), len(b))
    return a[:m] * np.uint64(pow(int(_BASE), size, 1 << 64)) + b[:m]


def _smaller(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    m = min(len(a), len(b))
    return np.minimum(a[:m], b[:m])


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes."""
    return mixed(_doubled(data.astype(np.uint64) + np.uint64(1), gram, _appended))


def _smallest_grams(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each window the smallest hash of the runs of ``gram`` bytes in it."""
    return _doubled(_grams(data, gram), width - gram + 1, _smaller)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base, and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _run_hashes(grams: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the n consecutive grams from each ``first`` on, from prefix sums: the same wherever they stand."""
    up, down = _powers(1 << max(16, int(len(grams) + 1).bit_length()))
    before = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * up[: len(grams)], out=before[1:])
    return mixed((before[first + n] - before[first]) * down[first] ^ n.astype(np.uint64) * _STEP)


def _pieces(b: pa.RecordBatch, width: int, size: int) -> Iterator[tuple[int, int, int, memoryview]]:
    """(id, doc, begin, bytes): texts in pieces that share width - 1 bytes, so each window lies in one piece."""
    for id_, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
        data = memoryview(text.as_buffer())
        for at in range(0, max(len(data) - width + 1, 0), size):
            yield id_, doc, at, data[at : at + size + width - 1]


def slices_for(text_bytes: int, shared: int, width: int = WIDTH, gram: int = GRAM, sliced_from: int = SLICED_FROM) -> int:
    """Into how many slices grams go if ``shared`` stretches of a text have a gram that several documents have."""
    if text_bytes < sliced_from:
        return 1
    all_ = text_bytes / ((width - gram) / 2 + 1)  # expected, as a smallest hash stands for so many windows
    return max(1, math.ceil((all_ * SHUFFLED_BYTES + shared * SHARED_BYTES) / (text_bytes * SLICE_SHARE)))


def _in_slice(gram: Column, number: int, slices: int) -> Column:
    return gram.bitwiseAND(F.lit(_LOW)) % slices == number


def stretches(
    texts: DataFrame, width: int = WIDTH, gram: int = GRAM, piece_bytes: int = PIECE_BYTES, most: int = STRETCH_BYTES, keyed: bool = True,
    number: int = 0, slices: int = 1,
) -> DataFrame:
    """gram, doc, and if ``keyed`` also key (hash of all its bytes), id, at (of the first window), n (windows),
    of ``texts`` (id, doc, text as binary), for the grams of slice ``number``."""
    schema = "gram long, doc long, key long, id long, at long, n int" if keyed else "gram long, doc long"

    def together(some: list) -> pa.RecordBatch:
        size = np.array([len(p[3]) for p in some])
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(p[3] for p in some), np.uint8)
        grams = _grams(data, gram)
        least = _doubled(grams, width - gram + 1, _smaller)
        begin, last = ends - size, ends - width + 1  # windows of a piece begin in [begin, last)
        change = np.append(True, least[1:] != least[:-1])
        change[begin] = True
        first = np.flatnonzero(change)
        of = np.searchsorted(begin, first, "right") - 1
        inside = first < last[of]
        first, of = first[inside], of[inside]
        n = np.minimum(np.append(first[1:], len(data)), last[of]) - first
        if slices > 1:
            mine = (least[first] & np.uint64(_LOW)) % np.uint64(slices) == number
            first, of, n = first[mine], of[mine], n[mine]
        ids, docs, at = (np.array([p[c] for p in some], np.int64) for c in (0, 1, 2))
        columns = [least[first].view(np.int64), docs[of]]
        if keyed:
            key = _run_hashes(grams, first, n + width - gram)
            columns += [key.view(np.int64), ids[of], at[of] + first - begin[of], n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in batches:
            for piece in _pieces(b, width, piece_bytes):
                some.append(piece)
                size += len(piece[3])
                if size >= most:
                    yield together(some)
                    some, size = [], 0
        if some:
            yield together(some)

    return in_small_batches(texts).mapInArrow(run, schema)


def _fetched(texts: DataFrame, wanted: DataFrame, width: int, piece_bytes: int) -> DataFrame:
    """gram, key, lo, hi, string: the bytes of the stretches ``wanted`` (gram, key, lo, hi, id, at, n)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(some: list) -> pa.RecordBatch:
            ids, pieces, data = zip(*some)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pieces), pa.array(data, pa.binary())], names=["id", "piece", "data"])

        some, size = [], 0
        for b in batches:
            for id_, _, at, data in _pieces(b, width, piece_bytes):
                some.append((id_, at // piece_bytes, bytes(data)))
                size += len(data)
                if size >= STRETCH_BYTES:
                    yield told(some)
                    some, size = [], 0
        if some:
            yield told(some)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = b.column(2)
            of = all_.flatten()  # the wanted stretches of all pieces of the batch
            at, n = of.field(4).to_pylist(), of.field(5).to_pylist()
            ends = (all_.offsets.to_numpy() - all_.offsets[0].as_py()).tolist()
            strings = []
            for piece, data, lo, hi in zip(b.column(0).to_pylist(), b.column(1), ends, ends[1:]):
                raw, base = data.as_py(), piece * piece_bytes
                strings += [raw[a - base : a - base + m + width - 1] for a, m in zip(at[lo:hi], n[lo:hi])]
            yield pa.RecordBatch.from_arrays([*(of.field(c) for c in range(4)), pa.array(strings, pa.binary())], names=["gram", "key", "lo", "hi", "string"])

    some = having(texts, stored(wanted.select("id").distinct(), "ids-with-repeats"), "id").select("id", "doc", "text")
    data = in_small_batches(some).mapInArrow(cut, "id long, piece long, data binary")
    piece = F.floor(F.col("at") / piece_bytes).cast("long")
    of_piece = wanted.groupBy("id", piece.alias("piece")).agg(F.collect_list(F.struct("gram", "key", "lo", "hi", "at", "n")).alias("all"))
    both = data.join(of_piece, ["id", "piece"]).select("piece", "data", "all")
    return both.mapInArrow(fetch, "gram long, key long, lo long, hi long, string binary")


OWNED = "gram long, key long, offset int, n int, owner long"


def _sorted_owners(classes: DataFrame, width: int, shallow: int, most: int) -> DataFrame:
    """Runs of windows of a class and the smallest document that has them, where that isn't the only one.
    ``classes``: gram, key, lo and hi (smallest and largest document that have it), string."""

    def owned(gram: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, strings: list[bytes]) -> pa.RecordBatch:
        size = np.array([len(s) for s in strings])
        n = size - width + 1
        of = np.repeat(np.arange(len(strings)), n)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        order, fresh = sorted_suffixes(np.frombuffer(b"".join(strings), np.uint8), (np.cumsum(size) - size)[of] + offset, width, shallow)
        first = np.flatnonzero(fresh)
        least = np.minimum.reduceat(lo[of][order], first)
        owner = np.empty(len(of), np.int64)
        owner[order] = np.repeat(least, np.diff(np.append(first, len(of))))
        begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])))
        runs = np.diff(np.append(begin, len(of)))
        use = owner[begin] < hi[of[begin]]
        begin, runs = begin[use], runs[use]
        columns = [gram[of[begin]], key[of[begin]], offset[begin].astype(np.int32), runs.astype(np.int32), owner[begin]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "key", "offset", "n", "owner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, strings, suffixes = [], [], 0
        for b in batches:
            for g, k, x, y, s in zip(*(c.to_pylist() for c in b.columns)):
                if suffixes >= most and g != numbers[-1][0]:
                    yield owned(*np.array(numbers, np.int64).T, strings)
                    numbers, strings, suffixes = [], [], 0
                numbers.append((g, k, x, y))
                strings.append(s)
                suffixes += len(s) - width + 1
        if strings:
            yield owned(*np.array(numbers, np.int64).T, strings)

    together = classes.select("gram", "key", "lo", "hi", "string").repartition("gram").sortWithinPartitions("gram")
    return together.mapInArrow(run, OWNED)


def _grouped_owners(classes: DataFrame, width: int) -> DataFrame:
    """The same for classes of crowded grams: windows are grouped by their bytes, which combine before
    the shuffle, and joined back."""
    each = classes.select("gram", "key", "lo", "hi", "string", F.explode(F.sequence(F.lit(0), F.octet_length("string") - width)).alias("offset"))
    each = each.select("gram", "key", "lo", "hi", "offset", F.expr(f"substring(string, offset + 1, {width})").alias("window"))
    owner = each.groupBy("window").agg(F.min("lo").alias("owner"))
    owned = each.join(owner, "window").where("owner < hi")
    return owned.select("gram", "key", F.col("offset").cast("int"), F.lit(1).alias("n"), "owner")


def _without(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` isn't in ``some``; up to a million of these are broadcast."""
    small = some.limit(1_000_001).count() <= 1_000_000
    return rows.join(F.broadcast(some) if small else some, key, "left_anti")


def _gone(
    texts: DataFrame, shared: DataFrame, number: int, slices: int, width: int, gram: int, shallow: int, classes_most: int, piece_bytes: int, stretch_bytes: int,
    sort_most: int,
) -> DataFrame:
    """id, start, end: runs of windows of a slice of the ``shared`` grams that a row with a smaller doc has too, stored."""
    marks = stretches(texts, width, gram, piece_bytes, stretch_bytes, number=number, slices=slices)
    marks = stored(marks.join(shared.where(_in_slice(F.col("gram"), number, slices)), "gram", "left_semi"), "shared-stretches")
    one = F.min(F.struct("id", "at", "n"))
    each = stored(marks.groupBy("gram", "key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), one.alias("one")).select("gram", "key", "lo", "hi", "one.*"), "each-class")
    classes = stored(each.join(each.groupBy("gram").agg(F.count("*").alias("c")), "gram"), "classes")
    discarded(each)
    several = classes.where("c > 1")
    alone = classes.where("c = 1").select("gram", "key", F.lit(0).alias("offset"), "n", F.col("lo").alias("owner"))
    strings = stored(_fetched(texts, several, width, piece_bytes), "strings")
    crowded = stored(several.where(F.col("c") > classes_most).select("gram").distinct(), "crowded-grams")
    if crowded.isEmpty():
        owners = _sorted_owners(strings, width, shallow, sort_most)
    else:
        sorted_ = _sorted_owners(_without(strings, crowded, "gram"), width, shallow, sort_most)
        owners = sorted_.unionByName(_grouped_owners(having(strings, crowded, "gram"), width))
    owners = stored(owners.unionByName(alone), "owners")
    discarded(strings, classes, crowded)
    gone = marks.select("gram", "key", "id", "doc", "at").join(owners, ["gram", "key"]).where("owner < doc")
    start = F.col("at") + F.col("offset")
    gone = stored(gone.select("id", start.alias("start"), (start + F.col("n") - 1 + width).alias("end")), "gone")
    discarded(marks, owners)
    return gone


def duplicate_spans(
    rows: DataFrame, width: int = WIDTH, gram: int = GRAM, shallow: int = SHALLOW, classes_most: int = CLASSES_MOST, piece_bytes: int = PIECE_BYTES,
    stretch_bytes: int = STRETCH_BYTES, sort_most: int = SORT_MOST, sliced_from: int = SLICED_FROM,
) -> DataFrame:
    """id, start, end: maximal runs of bytes of ``rows`` (id, doc, text as binary; ids are distinct) that
    are covered by windows which a row with a smaller doc has too; stored."""
    texts = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= width)).select("id", "doc", "text")
    bare = stretches(texts, width, gram, piece_bytes, stretch_bytes, keyed=False)
    counted = bare.groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c"))
    shared = stored(counted.where("lo < hi").select("gram", "c"), "shared-grams")
    text_bytes, repeats = (df.agg(F.sum(c)).first()[0] or 0 for df, c in ((texts, F.octet_length("text")), (shared, "c")))
    slices, grams = slices_for(text_bytes, repeats, width, gram, sliced_from), shared.select("gram")
    parts = [_gone(texts, grams, k, slices, width, gram, shallow, classes_most, piece_bytes, stretch_bytes, sort_most) for k in range(slices)]
    discarded(shared)
    gone = reduce(DataFrame.unionByName, parts)
    w = W.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    runs = gone.withColumn("before", before).withColumn("run", island)
    spans = stored(runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run"), "spans")
    discarded(*parts)
    return spans


def with_ids(docs: DataFrame) -> DataFrame:
    """id, doc, text (binary, empty for null) of every row."""
    rows = with_row_ids(docs)
    return rows.select("id", F.col("row")["doc_id"].cast("long").alias("doc"), F.coalesce(F.col("row")["text"], F.lit("")).cast("binary").alias("text"))


def without_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows without a span stay where they are; of the others up to a million ids are broadcast. Gives
    doc, n_bytes, n_removed, n_spans, kept (binary): ``rows`` (id, doc, text) without their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, count = [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist()):
                data, parts, at = memoryview(text.as_buffer()), [], 0
                for s in spans or ():
                    parts.append(data[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(len(data) - len(kept[-1]))
                count.append(len(spans or ()))
            n = [k + r for k, r in zip(map(len, kept), removed)]
            columns = [b.column(0), *[pa.array(c, pa.int64()) for c in (n, removed, count)], pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    of_row = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    ids = stored(spans.select("id").distinct(), "ids-with-spans")
    cut = in_small_batches(having(rows, ids, "id").join(of_row, "id").select("doc", "text", "spans"))
    size, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    whole = _without(rows, ids, "id").select("doc", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").alias("kept"))
    return cut.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(whole)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows = with_ids(table(spark, sf_dir, "documents"))
    return without_spans(rows, duplicate_spans(one_of_each(rows))).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL with the same result as :func:`op13_suffix_dedup`: all windows, as hexadecimal digits.
ORACLE = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
 p AS (SELECT doc_id, x, unnest(range(len(x) // 2 - 49)) p FROM d WHERE len(x) >= 100),
 w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) w FROM p),
 o AS (SELECT w, min(doc_id) o FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
 g AS (SELECT doc_id, p FROM w JOIN o USING (w) WHERE o < doc_id),
 i AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 50 fresh FROM g),
 r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) k FROM i),
 s AS (SELECT doc_id, k, min(p) b, max(p) + 50 e FROM r GROUP BY ALL),
 l AS (SELECT doc_id, list(b ORDER BY b) b, list(e ORDER BY b) e FROM s GROUP BY 1),
 f AS (SELECT d.doc_id, x, coalesce(b, []) b, coalesce(e, []) e FROM d LEFT JOIN l USING (doc_id)),
 k AS (SELECT *, array_to_string([substr(x, 2 * (CASE WHEN i = 0 THEN 0 ELSE e[i] END) + 1, 2 * ((CASE WHEN i = len(b) THEN len(x) // 2 ELSE b[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE e[i] END))) for i in range(len(b) + 1)], '') kept FROM f)
 SELECT doc_id, (len(x) // 2)::BIGINT n_bytes, ((len(x) - len(kept)) // 2)::BIGINT n_removed, len(b)::BIGINT n_spans, sha256(unhex(kept)) kept_sha256 FROM k"""
