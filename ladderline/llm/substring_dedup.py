"""Substring dedup by collinear chaining: fuzzy passages that an earlier document already has.

1. Seeds: all runs of five words, so a fuzzy passage has seeds wherever five words in a row are equal.
2. Each seed's first occurrence (smallest doc_id, then position) owns it; every other occurrence is
   matched with it. That is one match per occurrence however often a passage comes, never a pair of
   every two documents that share it.
3. Matches on one diagonal in a row are runs. A document's runs with one owner are chained: ordered in
   both, for the best sum of run weights less gap costs. A Fenwick tree over owner positions holds
   prefix maxima, so chaining n runs takes n log n.
4. Chains are aligned word by word: gaps between runs by edit distance, ends by extension until the
   score falls; where it comes near the last word fetched, more are. A chain below ``similarity``
   is cut into its longest stretches that reach it. A stretch of ``min_words`` or more counts: so many
   words of one earlier document, in one piece. Those that meet are one passage, whatever their owners.

The first document with a passage keeps it. Passages repeated within one document are left alone.

How seeds travel. Documents are taken in flushes of about ``flush_seeds`` seeds. A flush sorts its
seeds and sends only the first occurrence of each, packed into one row per bucket of hashes: 7 bytes
of hash, about a byte of position, and a document number per run. So a seed that a third of all
documents share reaches its bucket once per flush, and no task reads more of it. A bucket finds the
owners and answers every flush with its matches; other occurrences stay with their flush and take
the owner from the answer. Buckets number as many as the corpus has ``bucket_seeds``. For larger
inputs raise both with the executors' memory (about 60 bytes a seed): rows of few seeds pack badly.

Cases: null and empty texts, and texts below five words, have no seeds; rows with a null doc_id, and
rows that share one, are documents of their own, those with equal text one document; an empty table
gives an empty result; further columns, whatever their names, are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import having, in_small_batches, one_of_each, stored, table, with_row_ids
from ladderline.llm.hashing import shingle_hashes, slices, word_hashes

K = 5
MIN_WORDS = 50
SIMILARITY = 0.8
#: Cost of a word between two seeds of a chain, on either side; a seed weighs K.
GAP_COST = 0.1
#: Words beyond a chain's ends that alignment looks at first, how many times more where these don't
#: suffice, and the longest gap that is bridged when passages are put together.
FLANK, WIDER, BRIDGE = 32, 8, 3
#: How far an extension's score may fall before it ends.
DROP = 12
FLUSH_SEEDS, BUCKET_SEEDS = 1_000_000, 1_000_000
#: Bytes of text that a worker hashes at once.
_SLICE = 1 << 20
#: What a row of seeds holds: the first occurrences of a flush for a bucket, the other occurrences of
#: a flush, the matches that a bucket found for a flush, and owners for the other occurrences.
_FIRST, _OTHER, _MATCH, _OWNER = range(4)
_PARTS = 6
_ROWS = "key int, flush long, kind int, " + ", ".join(f"p{i} binary" for i in range(_PARTS))
_LOW = np.uint64((1 << 56) - 1)


def _positions(run_start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending numbers of each run as steps, in planes of their bytes (1, 1 and 2 of 4), which pack well."""
    step = np.diff(at, prepend=0)
    step[run_start] = at[run_start]
    b = step.astype("<u4").view(np.uint8).reshape(-1, 4)
    return b[:, 0], b[:, 1], b[:, 2:]


def _from_positions(counts: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    b = np.zeros((len(low), 4), np.uint8)
    b[:, 0], b[:, 1], b[:, 2:] = low, mid, high.reshape(-1, 2)
    total = np.cumsum(b.view("<u4").ravel().astype(np.int64))
    starts = np.cumsum(counts) - counts
    return total - np.repeat(total[starts] - b.view("<u4").ravel()[starts], counts)


def _rows(key, flush, kind: int, bounds: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each stretch of the parts; part i is cut at ``bounds[i]``."""
    n = len(bounds[0]) - 1
    cols = [pa.array(np.broadcast_to(np.asarray(key, np.int32), n)), pa.array(np.broadcast_to(np.asarray(flush, np.int64), n))]
    cols.append(pa.array(np.full(n, kind, np.int32)))
    for at, part in zip(bounds, parts):
        part = np.ascontiguousarray(part)
        width = part.dtype.itemsize * int(np.prod(part.shape[1:], dtype=np.int64))
        cols.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(part)]).cast(pa.binary()))
    cols += [pa.nulls(n, pa.binary())] * (_PARTS - len(parts))
    return pa.RecordBatch.from_arrays(cols, names=["key", "flush", "kind", *(f"p{i}" for i in range(_PARTS))])


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal values begins."""
    n = len(same[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0)
    return np.flatnonzero(new)


def _flush(docs: list, seeds: list, places: list, flush: int, buckets: int) -> Iterator[pa.RecordBatch]:
    doc, seed, at = (np.concatenate(x) for x in (docs, seeds, places))
    order = np.lexsort((at, doc))  # documents need not come in order
    doc, seed, at = doc[order], seed[order], at[order]
    by = np.argsort(seed, kind="stable")
    head = np.ones(len(by), bool)
    head[1:] = seed[by][1:] != seed[by][:-1]
    shared = np.zeros(len(by), bool)
    shared[:-1] |= ~head[1:]
    others = by[~head]
    if len(others):
        first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))][~head]
        yield _rows(flush % buckets, flush, _OTHER, [np.array([0, len(others)])] * 5, [seed[others], doc[others], at[others], doc[first], at[first]])
    flag = np.zeros(len(by), np.uint8)
    flag[by[shared & head]] = 1
    firsts = np.sort(by[head])  # in order of documents and places
    bucket = (seed[firsts] % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, firsts = bucket[order], firsts[order]
    doc, seed, at, flag = doc[firsts], seed[firsts], at[firsts], flag[firsts]
    rows = _runs(bucket)
    run = _runs(bucket, doc)
    low, mid, high = _positions(run, at)
    counts = np.diff(np.append(run, len(doc))).astype("<u4")
    bounds, run_bounds = np.append(rows, len(doc)), np.append(np.searchsorted(run, rows), len(run))
    runs = np.empty((len(run), 12), np.uint8)
    runs[:, :8], runs[:, 8:] = doc[run].astype("<i8").view(np.uint8).reshape(-1, 8), counts.view(np.uint8).reshape(-1, 4)
    yield _rows(
        bucket[rows].astype(np.int32), flush, _FIRST, [bounds, run_bounds, *[bounds] * 4],
        [seed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7], runs, low, mid, high, flag],
    )


def seeds(docs: DataFrame, buckets: int, k: int = K, flush_seeds: int = FLUSH_SEEDS) -> DataFrame:
    """Packed rows (see above) of the seeds of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seed, place, held = [], [], [], 0
        flush = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, done = b.column(0).to_numpy(zero_copy_only=False), 0
            for texts in slices(b.column(1), _SLICE):
                h, counts = word_hashes(texts)
                s, n = shingle_hashes(h, k), np.maximum(counts - k + 1, 0)
                starts = np.cumsum(counts) - counts
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                if len(within):
                    doc.append(np.repeat(ids[done : done + len(texts)].astype(np.int64), n))
                    seed.append(s[np.repeat(starts, n) + within])
                    place.append(within.astype(np.uint32))
                    held += len(within)
                done += len(texts)
                if held >= flush_seeds:
                    yield from _flush(doc, seed, place, flush, buckets)
                    doc, seed, place, held, flush = [], [], [], 0, flush + 1
        if held:
            yield from _flush(doc, seed, place, flush, buckets)

    return in_small_batches(docs.select("id", "text")).mapInArrow(run, _ROWS)


def _joined(columns: list[list], kind) -> np.ndarray:
    return np.frombuffer(b"".join(columns), kind)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's first occurrences: for each flush its matches with earlier documents, and the
    owners of seeds that come again in the flush. Other occurrences pass through."""
    flushes, sizes, parts = [], [], [[] for _ in range(_PARTS)]
    for b in batches:
        kind = b.column(2).to_numpy()
        if (kind == _OTHER).any():
            yield b.filter(pa.array(kind == _OTHER))
        some = b.filter(pa.array(kind == _FIRST))
        if len(some):
            flushes += some.column(1).to_pylist()
            for i, p in enumerate(parts):
                p += some.column(3 + i).to_pylist()
            sizes += [len(x) for x in parts[5][len(sizes) :]]
    if not sizes:
        return
    seven = _joined(parts[0], np.uint8).reshape(-1, 7)
    seed = np.zeros((len(seven), 8), np.uint8)
    seed[:, :7] = seven
    seed = seed.view("<u8").ravel()
    runs = _joined(parts[1], np.uint8).reshape(-1, 12)
    counts = runs[:, 8:].copy().view("<u4").ravel().astype(np.int64)
    doc = np.repeat(runs[:, :8].copy().view("<i8").ravel(), counts)
    at = _from_positions(counts, *(_joined(parts[i], np.uint8) for i in (2, 3, 4)))
    flag = _joined(parts[5], np.uint8)
    flush = np.repeat(np.arange(len(sizes)), sizes)
    del parts, seven
    by = np.argsort(seed)
    twice = np.zeros(len(by), bool)
    alike = seed[by][1:] == seed[by][:-1]
    twice[1:] |= alike
    twice[:-1] |= alike
    some = by[twice]
    if not len(some):
        return
    some = some[np.lexsort((at[some], doc[some], seed[some]))]
    seed, doc, at, flag, flush = seed[some], doc[some], at[some], flag[some], flush[some]
    group = np.repeat(g := _runs(seed), np.diff(np.append(g, len(seed))))
    owner, place = doc[group], at[group]
    # owners of seeds that come again in a flush
    tell = np.flatnonzero((flag == 1) & ((doc != owner) | (at != place)))
    tell = tell[np.argsort(flush[tell], kind="stable")]
    number = np.array(flushes, np.int64)
    if len(tell):
        rows = _runs(number[flush[tell]])
        yield _rows(0, number[flush[tell]][rows], _OWNER, [np.append(rows, len(tell))] * 3, [seed[tell], owner[tell], place[tell].astype("<u4")])
    found = np.flatnonzero(doc != owner)
    found = found[np.lexsort((at[found], doc[found], number[flush[found]]))]
    if len(found):
        flush, doc, at, owner = number[flush[found]], doc[found], at[found], owner[found]
        diagonal = place[found].astype(np.int64) - at
        rows, run = _runs(flush), _runs(flush, doc, owner, diagonal)
        low, mid, high = _positions(run, at)
        runs = np.empty((len(run), 24), np.uint8)
        for x, kind, a in ((doc, "<i8", 0), (owner, "<i8", 8), (diagonal, "<i4", 16)):
            size = np.dtype(kind).itemsize
            runs[:, a : a + size] = x[run].astype(kind).view(np.uint8).reshape(-1, size)
        runs[:, 20:] = np.diff(np.append(run, len(doc))).astype("<u4").view(np.uint8).reshape(-1, 4)
        bounds, run_bounds = np.append(rows, len(doc)), np.append(np.searchsorted(run, rows), len(run))
        yield _rows(0, flush[rows], _MATCH, [run_bounds, *[bounds] * 3], [runs, low, mid, high])


def _matches(kinds: list[int], parts: list[list]) -> tuple[np.ndarray, ...]:
    """doc, owner, i, j, length of the runs of a flush, in that order, from all its rows."""
    of = lambda kind, i: [p for x, p in zip(kinds, parts[i]) if x == kind]
    runs = _joined(of(_MATCH, 0), np.uint8).reshape(-1, 24)
    counts = runs[:, 20:].copy().view("<u4").ravel().astype(np.int64)
    doc, owner = (np.repeat(runs[:, a : a + 8].copy().view("<i8").ravel(), counts) for a in (0, 8))
    i = _from_positions(counts, *(_joined(of(_MATCH, x), np.uint8) for x in (1, 2, 3)))
    j = i + np.repeat(runs[:, 16:20].copy().view("<i4").ravel(), counts)
    if others := of(_OTHER, 0):
        seed, d, at = (_joined(others, "<u8") & _LOW, _joined(of(_OTHER, 1), "<i8"), _joined(of(_OTHER, 2), "<u4").astype(np.int64))
        o, p = _joined(of(_OTHER, 3), "<i8").copy(), _joined(of(_OTHER, 4), "<u4").astype(np.int64)
        told = _joined(of(_OWNER, 0), "<u8")
        if len(told):
            by = np.argsort(told)
            told = told[by]
            where = np.minimum(np.searchsorted(told, seed), len(told) - 1)
            hit = told[where] == seed
            o[hit] = _joined(of(_OWNER, 1), "<i8")[by][where[hit]]
            p[hit] = _joined(of(_OWNER, 2), "<u4").astype(np.int64)[by][where[hit]]
        some = o != d
        doc, owner, i, j = (np.concatenate(x) for x in ((doc, d[some]), (owner, o[some]), (i, at[some]), (j, p[some])))
    ids, number = np.unique(doc, return_inverse=True)
    by = np.argsort((number.astype(np.uint64) << np.uint64(32)) | i.astype(np.uint64))
    number, owner, i, j = number[by], owner[by], i[by], j[by]
    if len(i):  # equal rows that are one document give each match twice
        new = np.append(True, (np.diff(number) != 0) | (np.diff(i) != 0))
        number, owner, i, j = number[new], owner[new], i[new], j[new]
    begin = _runs(number, owner, i - np.arange(len(i)), j - i)
    length = np.diff(np.append(begin, len(i)))
    number, owner, i, j = number[begin], owner[begin], i[begin], j[begin]
    by = np.lexsort((i, owner, number))
    return ids[number[by]] if len(ids) else number, owner[by], i[by], j[by], length[by]


def chains(i: np.ndarray, j: np.ndarray, n: np.ndarray, k: int = K, gap: float = GAP_COST) -> list[np.ndarray]:
    """Best collinear chains, as indexes into the runs (sorted by i, then j); each run in one at most.

    A run of n seeds weighs n * k less the cost of its n - 1 steps; the next one must begin after its
    last seed on both sides.
    """
    size = len(i)
    if size == 1:
        return [np.arange(1)]
    last_i, last_j = i + n - 1, j + n - 1
    di, dj = i[1:] - last_i[:-1], j[1:] - last_j[:-1]
    if di.min() > 0 and dj.min() > 0 and gap * (di + dj).max() < k:
        return [np.arange(size)]
    own = (n * k - 2 * gap * (n - 1)).tolist()
    ends = np.unique(last_j)
    upto, rank = np.searchsorted(ends, j).tolist(), (np.searchsorted(ends, last_j) + 1).tolist()
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (len(ends) + 1)
    score, back = [0.0] * size, [-1] * size
    first, begin = (i + j).tolist(), i.tolist()
    closing, after = np.argsort(last_i, kind="stable").tolist(), (last_i + last_j).tolist()
    stop, closed = last_i.tolist(), 0
    for c in range(size):
        while closed < size and stop[closing[closed]] < begin[c]:  # runs that have ended before this one
            x = closing[closed]
            entry, r = (score[x] + gap * after[x], x), rank[x]
            while r <= len(ends):
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
            closed += 1
        best, r = (-1e300, -1), upto[c]
        while r:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        gained = best[0] - gap * first[c]
        score[c], back[c] = (own[c] + gained, best[1]) if gained > 0 else (float(own[c]), -1)
    used, out = [False] * size, []
    for c in sorted(range(size), key=lambda x: (-score[x], x)):
        chain = []
        while c >= 0 and not used[c]:
            used[c] = True
            chain.append(c)
            c = back[c]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def _edit_matches(a: list[int], b: list[int]) -> int:
    """Equal words in an alignment of fewest edits, the most of any such."""
    edit = len(a) + len(b) + 1  # an edit costs more than all matches can make up for
    x, steps = np.array(b), np.arange(len(b) + 1) * edit
    row = steps.copy()
    for w in a:
        new = row + edit
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(x == w, -1, edit))
        row = np.minimum.accumulate(new - steps) + steps
    return int(-row[-1] % edit)


def _extend(a: list[int], b: list[int], spare: float = 0.0, cost: float = 4.0) -> tuple[int, int, int]:
    """From the start of both: words taken of a and of b, and how many are equal. Equal words run on; one
    edit is crossed where the three words after it agree; else a banded alignment looks further."""
    x = y = same = 0
    while True:
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y, same = x + 1, y + 1, same + 1
        for p, q in ((1, 1), (1, 0), (0, 1)):
            if len(a) >= x + p + 3 and len(b) >= y + q + 3 and a[x + p : x + p + 3] == b[y + q : y + q + 3]:
                x, y = x + p, y + q
                break
        else:
            p, q, more = _beyond(a, b, x, y, spare + same - cost * (max(x, y) - same), cost)
            if p == x:
                return x, y, same
            x, y, same = p, q, same + more


def _beyond(a: list[int], b: list[int], x: int, y: int, spare: float, cost: float) -> tuple[int, int, int]:
    """The furthest place from (x, y) on, behind two equal words, where equal words less ``cost`` an edit and
    ``spare`` from what lies before still make up for each other. A path that falls ``DROP`` below the best
    one ends, so unlike text is left after a few words."""
    furthest, edits = (x, y, 0), int(DROP / cost)
    if not set(a[x : x + edits + 1]) & set(b[y : y + edits + 1]):  # no path lives to see an equal word
        return furthest
    best, dead = 0.0, -2.0 * DROP
    row = {y + j: (-cost * j, 0, 0) for j in range(min(edits, len(b) - y) + 1)}  # b's words taken: score, equal, equal in a row
    for i in range(x, len(a)):
        w, new = a[i], {}
        for j, (s, m, run) in row.items():
            if s - cost > (new[j][0] if j in new else dead):
                new[j] = (s - cost, m, 0)
            if j < len(b):
                step = (s + 1, m + 1, run + 1) if b[j] == w else (s - cost, m, 0)
                if step[0] > (new[j + 1][0] if j + 1 in new else dead):
                    new[j + 1] = step
        for j in sorted(new):
            s, m, _ = new[j]
            if j < len(b) and s - cost > (new[j + 1][0] if j + 1 in new else dead):
                new[j + 1] = (s - cost, m, 0)
        best = max(best, *(v[0] for v in new.values())) if new else best
        row = {j: v for j, v in new.items() if v[0] >= best - DROP}
        if not row:
            break
        j, (s, m, run) = max(row.items(), key=lambda r: (r[1][0], r[0]))
        if run >= 2 and s + spare >= 0:
            furthest = (i + 1, j, m)
            if run >= 8 and len(row) > 1:  # the way is clear: equal words run on without a search
                break
    return furthest


def pieces(a: list[int], b: list[int], at: list[tuple[int, int, int]]) -> tuple[list[list[int]], list[int]]:
    """Blocks of equal words along the runs ``at`` (place in a, in b, words), as [start in a, end in a,
    start in b, end in b], and the equal words in each gap between one block and the next."""
    x, y, n = at[0]
    blocks, inside = [[x, x + n, y, y + n]], []
    for x, y, n in at[1:]:
        _, px, _, py = last = blocks[-1]
        over = max(px - x, py - y, 0)  # runs may share words, never seeds
        x, y, n = x + over, y + over, n - over
        if n <= 0:
            continue
        while px < x and py < y and a[px] == b[py]:
            px, py = px + 1, py + 1
        last[1], last[3] = px, py
        u, v = x, y
        while u > px and v > py and a[u - 1] == b[v - 1]:
            u, v = u - 1, v - 1
        if u == px and v == py:
            last[1], last[3] = x + n, y + n
        else:
            blocks.append([u, x + n, v, y + n])
            inside.append(_edit_matches(a[px:u], b[py:v]) if u > px and v > py else 0)
    return blocks, inside


def _whole(blocks: list[list[int]], inside: list[int], a: list[int], b: list[int], low=(0, 0), high=None, similarity: float = SIMILARITY) -> tuple[int, int, int, int, int]:
    """The blocks and gaps as one stretch, extended at both ends within ``low`` and ``high``. What its words
    have over ``similarity`` may make up for an end below it."""
    (x0, _, y0, _), (_, x1, _, y1) = blocks[0], blocks[-1]
    high = high or (len(a), len(b))
    cost = similarity / (1 - similarity) if similarity < 1 else 1e9
    same = sum(min(x[1] - x[0], x[3] - x[2]) for x in blocks) + sum(inside)
    spare = max(same - cost * (max(x1 - x0, y1 - y0) - same), 0.0)
    back = _extend(a[low[0] : x0][::-1], b[low[1] : y0][::-1], spare, cost)
    spare = max(spare + back[2] - cost * (max(back[:2]) - back[2]), 0.0)
    on = _extend(a[x1 : high[0]], b[y1 : high[1]], spare, cost)
    return x0 - back[0], x1 + on[0], y0 - back[1], y1 + on[1], same + back[2] + on[2]


def align(a: list[int], b: list[int], at: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """Align word lists along the runs ``at``: start and end in a and in b, and equal words."""
    return _whole(*pieces(a, b, at), a, b)


def _share(s: tuple[int, int, int, int, int]) -> float:
    return s[4] / max(s[1] - s[0], s[3] - s[2], 1)


def _longest(blocks: list[list[int]], inside: list[int], similarity: float) -> tuple[int, int]:
    """First and last block of the longest run that reaches ``similarity``, each gap as long as its longer side."""
    t = np.array(blocks)
    size = np.minimum(t[:, 1] - t[:, 0], t[:, 3] - t[:, 2]) * (1 - similarity)
    wide = np.maximum(t[1:, 0] - t[:-1, 1], t[1:, 2] - t[:-1, 3])
    upto = np.cumsum(size + np.append(0, np.array(inside) - similarity * wide))  # with block q
    before = upto - size  # before block p
    low = np.minimum.accumulate(before)
    first = np.searchsorted(-low, -upto - 1e-9)  # the first p from where the sum up to q isn't negative
    q = int(np.argmax(t[:, 1] - t[first, 0]))
    return int(first[q]), q


def stretches(
    a: list[int], b: list[int], at: list[tuple[int, int, int]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS
) -> list[tuple[int, int, int, int, int]]:
    """What reaches ``similarity`` along the runs ``at``, as :func:`align` tells it: the whole chain, or
    else its longest such stretch and what is found so on both sides of it. Where a gap holds more words
    of its own than a passage of ``min_words`` may and both sides are passages by themselves, it is cut."""
    if len(at) == 1:
        x, y, n = at[0]
        whole = _whole([[x, x + n, y, y + n]], [], a, b, similarity=similarity)
        return [whole if _share(whole) >= similarity else (x, x + n, y, y + n, n)]
    blocks, inside = pieces(a, b, at)
    out, todo = [], [(0, len(blocks) - 1)]
    while todo:
        p, q = todo.pop()
        # ends stay between the blocks before and after
        low = (blocks[p - 1][1], blocks[p - 1][3]) if p else (0, 0)
        high = (blocks[q + 1][0], blocks[q + 1][2]) if q + 1 < len(blocks) else (len(a), len(b))
        whole = _whole(blocks[p : q + 1], inside[p:q], a, b, low, high, similarity)
        if _share(whole) < similarity:
            f, g = _longest(blocks[p : q + 1], inside[p:q], similarity)
            f, g = f + p, g + p
            if (f, g) != (p, q):
                todo += [(x, y) for x, y in ((p, f - 1), (f, g), (g + 1, q)) if x <= y]
                continue
            low, high = (blocks[p][0], blocks[p][2]), (blocks[q][1], blocks[q][3])  # only its ends are unlike
            out.append(_whole(blocks[p : q + 1], inside[p:q], a, b, low, high, similarity))
            continue
        own = lambda c: max(blocks[c + 1][0] - blocks[c][1], blocks[c + 1][2] - blocks[c][3]) - inside[c]
        for c in sorted((c for c in range(p, q) if own(c) > (1 - similarity) * min_words), key=own, reverse=True):
            left = _whole(blocks[p : c + 1], inside[p:c], a, b, low, (blocks[c + 1][0], blocks[c + 1][2]), similarity)
            right = _whole(blocks[c + 1 : q + 1], inside[c + 1 : q], a, b, (blocks[c][1], blocks[c][3]), high, similarity)
            if all(s[1] - s[0] >= min_words and _share(s) >= similarity for s in (left, right)):
                todo += [(p, c), (c + 1, q)]
                break
        else:
            out.append(whole)
    return sorted(out)


def _chained(k: int, flank: int):
    """Of a flush's rows its chains: doc_id, owner, where their words begin and how many to fetch (with
    flanks), and their runs (places from there on, and words)."""
    names = ["doc_id", "owner", "a", "na", "b", "nb", "xs", "ys", "ns"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.list_(pa.int32())] * 3]

    def alone(doc, owner, i, j, n) -> pa.RecordBatch:  # chains of one run each
        a, b, n = np.maximum(i - flank, 0), np.maximum(j - flank, 0), n + k - 1
        one = pa.array(np.arange(len(doc) + 1, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(one, pa.array(x.astype(np.int32))) for x in (i - a, j - b, n)]
        whole = [pa.array(x.astype(np.int32)) for x in (a, i + n + flank - a, b, j + n + flank - b)]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(owner), *whole, *lists], names=names)

    def of(doc, owner, i, j, n) -> Iterator[tuple]:
        starts = _runs(doc, owner)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)]):
            for c in chains(i[s:e], j[s:e], n[s:e], k):
                ci, cj, cn = i[s:e][c], j[s:e][c], n[s:e][c] + k - 1
                a, b = max(0, int(ci[0]) - flank), max(0, int(cj[0]) - flank)
                na, nb = int(ci[-1] + cn[-1]) + flank - a, int(cj[-1] + cn[-1]) + flank - b
                yield int(doc[s]), int(owner[s]), a, na, b, nb, (ci - a).tolist(), (cj - b).tolist(), cn.tolist()

    def batch(kinds_: list[int], parts: list[list]) -> Iterator[pa.RecordBatch]:
        runs = _matches(kinds_, parts)
        starts = _runs(*runs[:2])
        size = np.diff(np.append(starts, len(runs[0])))
        lone = starts[size == 1]
        for x in range(0, len(lone), 4096):
            yield alone(*(r[lone[x : x + 4096]] for r in runs))
        some, held = np.repeat(size > 1, size), []
        for r in of(*(r[some] for r in runs)):
            held.append(r)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, kinds_, parts = None, [], [[] for _ in range(_PARTS)]
        for b in batches:
            ids = b.column(1).to_numpy()
            starts = _runs(ids)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                if flush is not None and ids[s] != flush:
                    yield from batch(kinds_, parts)
                    kinds_, parts = [], [[] for _ in range(_PARTS)]
                flush = ids[s]
                kinds_ += b.column(2).slice(s, e - s).to_pylist()
                for i, p in enumerate(parts):
                    p += b.column(3 + i).slice(s, e - s).to_pylist()
        if kinds_:
            yield from batch(kinds_, parts)

    return run


def chained(docs: DataFrame, k: int = K, flush_seeds: int = FLUSH_SEEDS, bucket_seeds: int = BUCKET_SEEDS) -> DataFrame:
    """Chains of the documents (id, text) with those before them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size / 6.5 / bucket_seeds) + 1  # letters and a space, or so, a seed
    buckets += 1 - buckets % 2  # odd: the hash bits that aren't sent are in the bucket's number
    schema = "doc_id long, owner long, a int, na int, b int, nb int, xs array<int>, ys array<int>, ns array<int>"
    by_bucket = seeds(docs, buckets, k, flush_seeds).repartitionById(buckets, "key")
    answers = by_bucket.mapInArrow(_owners, _ROWS)
    by_flush = answers.repartition(buckets, "flush").sortWithinPartitions("flush")
    return by_flush.mapInArrow(_chained(k, FLANK), schema)


def word_table(docs: DataFrame) -> DataFrame:
    """id and its words as 32-bit hashes, four bytes each, so that a stretch is a substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1), _SLICE):
                h, counts = word_hashes(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                data = (h >> np.uint64(32)).astype("<u4").tobytes()
                words = pa.array([data[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), words], names=["id", "words"])
                at += len(texts)

    return docs.select("id", "text").mapInArrow(run, "id long, words binary")


def _words_at(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The words at ``at`` of texts that lie one after another in ``flat``; ``none`` outside of a text."""
    there = (at >= 0) & (at < length)
    out = np.full(len(at), none, np.int64)
    out[there] = flat[start[there] + at[there]]
    return out


#: How far from its ends the first step of an extension looks: an edit and three equal words.
_STEP = 4


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of one run, with a few words around them: does an end go on? The first step of
    :func:`_extend`, for all rows at once."""
    for b in batches:
        x, y, n, a, c = (b.column(name).to_numpy().astype(np.int64) for name in ("x", "y", "n", "a", "b"))
        sides = []
        for name, none in (("wa", -1), ("wb", -2)):
            w = b.column(name).cast(pa.large_binary())
            ends = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1] // 4
            flat = np.frombuffer(w.buffers()[2], "<u4") if w.buffers()[2] is not None else np.zeros(0, "<u4")
            sides.append((flat, ends[:-1], np.diff(ends), none))
        one, two = (lambda at, s=s: _words_at(s[0], s[1], s[2], at, s[3]) for s in sides)
        more = np.zeros(len(n), bool)
        for sign, u, v in ((1, x - a + n, y - c + n), (-1, x - a - 1, y - c - 1)):
            more |= one(u) == two(v)
            for p, q in ((1, 1), (1, 0), (0, 1)):
                more |= np.all([one(u + sign * (p + z)) == two(v + sign * (q + z)) for z in range(_STEP - 1)], axis=0)
        yield pa.RecordBatch.from_arrays([*(b.column(name) for name in ("doc_id", "owner", "x", "y", "n")), pa.array(more)], names=["doc_id", "owner", "x", "y", "n", "more"])


_CHAIN = "a int, na int, b int, nb int, xs array<int>, ys array<int>, ns array<int>, reach int"


def _aligned(rows: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """Stretches of the chains ``rows`` (with their words); and the chain again where an extension came near the
    last word that was fetched, which isn't the last there is: ``before`` and ``after`` are the
    places of the document where it may go on."""
    schema = f"doc_id long, owner long, start int, stop int, similarity double, {_CHAIN}, before int, after int, low int, high int"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.int32()] * 4, *[pa.list_(pa.int32())] * 3, *[pa.int32()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            plain = (batch.column(c).to_pylist() for c in ("doc_id", "owner", "a", "na", "b", "nb", "reach"))
            large = [batch.column(c) for c in ("xs", "ys", "ns", "wa", "wb")]
            for n, (doc, owner, a, na, b, nb, reach) in enumerate(zip(*plain)):  # a row's lists at a time: a long document's are large
                xs, ys, ns, wa, wb = (c[n].as_py() for c in large)
                la, lb = np.frombuffer(wa, "<u4").tolist(), np.frombuffer(wb, "<u4").tolist()
                found = stretches(la, lb, list(zip(xs, ys, ns)), similarity, min_words)
                # what counts for the first of a word said again and again counts up to the last
                last = [max(s[1], xs[0] + reach) if reach and s[1] - s[0] >= min_words else s[1] for s in found]
                out += [(doc, owner, a + s[0], a + e, _share(s), *[None] * 12) for s, e in zip(found, last)]
                # an end in the outer half of the words fetched beyond the runs may go on where there are more
                left = (a and xs[0] / 2, b and ys[0] / 2)
                right = [(size + last) / 2 if len(got) == size else size for size, last, got in ((na, xs[-1] + ns[-1], la), (nb, ys[-1] + ns[-1], lb))]
                before = after = low = high = None
                for s in found:
                    back, on = s[0] < left[0] or s[2] < left[1], s[1] > right[0] or s[3] > right[1]
                    if (back or on) and s[1] - s[0] < min_words:
                        low, high = a + s[0], a + s[1]
                    else:
                        before, after = a + s[0] if back else before, a + s[1] if on else after
                if (before, after, low) != (None, None, None):
                    out.append((doc, owner, None, None, None, a, na, b, nb, xs, ys, ns, reach, before, after, low, high))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=names)

    return rows.mapInArrow(run, schema)


def _uncovered(chains: DataFrame, spans: DataFrame) -> DataFrame:
    """The chains that go on where no span that counts holds their document's words already: these are taken
    anyway, by whose chain doesn't matter. A stretch that doesn't count yet (``low`` to ``high``) goes on
    unless a span holds all of it but less than a seed at its ends."""
    held = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("held"))
    any_ = lambda test: F.exists(F.coalesce("held", F.array().cast("array<struct<start:int,stop:int>>")), test)
    there = lambda place: any_(lambda s: (s["start"] <= place) & (place < s["stop"]))
    open_ = (F.col("before").isNotNull() & ~there(F.col("before") - 1)) | (F.col("after").isNotNull() & ~there(F.col("after")))
    short = F.col("low").isNotNull() & ~any_(lambda s: (s["start"] < F.col("low") + K) & (s["stop"] > F.col("high") - K))
    return chains.join(held, "doc_id", "left").where(open_ | short).drop("held")


def _once(lone: DataFrame) -> DataFrame:
    """Chains of one run with ``reach``. Runs of a document that are matched with one place of the owner and
    begin less than a seed apart are a word, or a few, said again and again. The first stands for them
    all; ``reach`` is how far from its place the last one ends."""
    again = W.partitionBy("doc_id", "owner", "y").orderBy("x")
    rows = lone.withColumn("new", F.coalesce(F.col("x") - F.lag("x").over(again) >= K, F.lit(True)).cast("int"))
    rows = rows.withColumn("no", F.sum("new").over(again))
    first = rows.groupBy("doc_id", "owner", "y", "no").agg(F.min("x").alias("x"), F.min_by("n", "x").alias("n"), F.max(F.col("x") + F.col("n")).alias("end"))
    return first.select("doc_id", "owner", "x", "y", "n", (F.col("end") - F.col("x")).alias("reach"))


def _widened(chains: DataFrame, more: int) -> DataFrame:
    """The chains with ``more`` words fetched on either side."""
    by = chains.withColumns({f"by_{c}": F.least(F.col(c), F.lit(more)) for c in ("a", "b")})  # words before those there are
    moved = lambda places, by: F.transform(places, lambda x: x + F.col(by)).alias(places)
    size = lambda n, by: (F.col(n) + F.col(by) + more).alias(n)
    return by.select(
        "doc_id", "owner", (F.col("a") - F.col("by_a")).alias("a"), size("na", "by_a"), (F.col("b") - F.col("by_b")).alias("b"), size("nb", "by_b"),
        moved("xs", "by_a"), moved("ys", "by_b"), "ns", "reach",
    )


def _with_words(rows: DataFrame, text: DataFrame) -> DataFrame:
    """``rows`` with ``wa``, the ``na`` words from ``a`` on of their documents, and ``wb`` of their owners."""
    part = lambda at, n: F.expr(f"substring(words, 4 * {at} + 1, 4 * {n})")
    own_text = having(text, rows.select(F.col("doc_id").alias("id")).distinct(), "id").withColumnRenamed("id", "doc_id")
    own = rows.join(own_text, "doc_id").withColumn("wa", part("a", "na")).drop("words")
    owners = having(text, rows.select(F.col("owner").alias("id")).distinct(), "id").withColumnRenamed("id", "owner")
    return own.join(owners, "owner").withColumn("wb", part("b", "nb")).drop("words")


def _chain_of(x: Column, y: Column, n: Column, flank: int) -> list[Column]:
    """Columns a, na, b, nb of a chain of one run."""
    a, b = F.greatest(x - flank, F.lit(0)), F.greatest(y - flank, F.lit(0))
    return [a.alias("a"), (x + n + flank - a).alias("na"), b.alias("b"), (y + n + flank - b).alias("nb")]


def _passages(docs: DataFrame, min_words: int, similarity: float, k: int, flush_seeds: int, bucket_seeds: int) -> DataFrame:
    """:func:`passages` of (id, text), by id."""
    found = stored(chained(docs, k, flush_seeds, bucket_seeds), "chains")
    ids = found.select(F.col("doc_id").alias("id")).union(found.select("owner")).distinct()
    text = stored(word_table(one_of_each(having(docs, ids, "id"))), "words")
    # most chains are one run whose ends don't go on: a few words tell
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    lone = found.where("size(ns) = 1").select("doc_id", "owner", (F.col("a") + F.col("xs")[0]).alias("x"), (F.col("b") + F.col("ys")[0]).alias("y"), F.col("ns")[0].alias("n"))
    lone = _with_words(lone.select("*", *_chain_of(x, y, n, _STEP)), text).select("doc_id", "owner", "x", "y", "n", "a", "b", "wa", "wb")
    lone = stored(lone.mapInArrow(_ends, "doc_id long, owner long, x int, y int, n int, more boolean"), "ends")
    a, na, b, nb = _chain_of(x, y, n, FLANK)
    lists = [F.array(x - a).alias("xs"), F.array(y - b).alias("ys"), F.array(n).alias("ns")]
    several = _once(lone.where("more")).select("doc_id", "owner", a, na, b, nb, *lists, "reach")
    chain = found.where("size(ns) > 1").withColumn("reach", F.lit(0)).unionByName(several)
    one = lone.where("not more").select("doc_id", "owner", x.alias("start"), (x + n).alias("stop"), F.lit(1.0).alias("similarity"))
    spans, more = one.where(F.col("stop") - F.col("start") >= min_words), FLANK
    while chain is not None:
        columns = ["doc_id", "owner", *[c.split()[0] for c in _CHAIN.split(", ")]]
        found = stored(_aligned(_with_words(chain.select(*columns), text), similarity, min_words), "stretches")
        spans = spans.unionByName(found.where(F.col("stop") - F.col("start") >= min_words).select("doc_id", "owner", "start", "stop", "similarity"))
        more *= WIDER
        again = stored(_uncovered(found.where("start is null"), spans), "chains-that-go-on")
        chain = None if again.isEmpty() else _widened(again, more)
    # a document's stretches that count, in order; one that begins where those before it have ended, or nearly, goes on
    span = F.sort_array(F.collect_list(F.struct("start", "stop", "owner", "similarity")))
    empty = F.array().cast("array<struct<start:int,stop:int,owners:array<bigint>,similarity:double>>")
    made = lambda start, stop, owners, share: F.array(
        F.struct(start.alias("start"), stop.alias("stop"), owners.alias("owners"), share.alias("similarity"))
    )

    def step(acc, s):
        last = F.get(acc, F.size(acc) - 1)
        goes_on = (F.size(acc) > 0) & (s["start"] <= last["stop"] + BRIDGE)
        longer = made(
            last["start"],
            F.greatest(last["stop"], s["stop"]),
            F.array_union(last["owners"], F.array(s["owner"])),
            F.least(last["similarity"], s["similarity"]),
        )
        fresh = made(s["start"], s["stop"], F.array(s["owner"]), s["similarity"])
        return F.when(goes_on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, fresh))

    merged = spans.groupBy("doc_id").agg(span.alias("s")).select("doc_id", F.explode(F.aggregate("s", empty, step)).alias("m"))
    return merged.select(
        "doc_id",
        F.col("m.start").alias("start"),
        (F.col("m.stop") - F.col("m.start")).alias("n_words"),
        F.sort_array("m.owners").alias("source_ids"),
        F.round("m.similarity", 6).alias("similarity"),
    )


def passages(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    k: int = K,
    flush_seeds: int = FLUSH_SEEDS,
    bucket_seeds: int = BUCKET_SEEDS,
) -> DataFrame:
    """One row per repeated passage: doc_id, id (see :func:`with_row_ids`), start and n_words (in words),
    source_ids (ids of documents that have it, or ``min_words`` of it, before this one), similarity (the
    least of its stretches)."""
    rows = with_row_ids(docs)
    found = _passages(rows.select("id", F.col("row")["text"].alias("text")), min_words, similarity, k, flush_seeds, bucket_seeds)
    found = found.withColumnRenamed("doc_id", "id")
    shared = one_of_each(rows).where("id < 0").select("id", F.col("row")["doc_id"].cast("long").alias("of"))
    shared = stored(shared, "ids-of-rows")
    if shared.isEmpty():
        return found.select(F.col("id").alias("doc_id"), "*")
    of = F.when(F.col("id") < 0, F.col("of")).otherwise(F.col("id")).alias("doc_id")
    return found.join(shared, "id", "left").select(of, *found.columns)


#: A word with what separates it from the one before it, where that one ended.
_PIECE = "\\G[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++"


def cut_words(text: Column, spans: Column) -> Column:
    """The text without the words at the spans (start, n_words), and without the separators before them."""
    piece = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    inside = lambda i: F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["n_words"]))
    left = F.array_join(F.filter(piece, lambda p, i: ~inside(i)), "")
    return F.concat(left, F.substr(text, F.length(F.array_join(piece, "")) + 1))


def remove_passages(docs: DataFrame, found: DataFrame, most: int = 200_000) -> DataFrame:
    """``docs`` with the passages cut out of ``text``; documents that lose all their words go. Each row is
    cut by its own passages, whatever else has its doc_id. Up to ``most`` documents' passages are broadcast,
    so texts stay where they are; beyond that both sides are shuffled."""
    rows = with_row_ids(docs)
    by_id = stored(found.groupBy("id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans")), "spans")
    by_id = F.broadcast(by_id) if by_id.limit(most + 1).count() <= most else by_id
    both = rows.join(by_id, "id", "left")
    text, hit = F.col("row")["text"], F.col("spans").isNotNull()
    both = both.withColumn("cut", F.when(hit, cut_words(text, F.col("spans")))).where(~hit | F.col("cut").rlike("[^\\x20\\x09-\\x0D]"))
    row = F.when(hit, F.col("row").withField("text", F.col("cut"))).otherwise(F.col("row"))
    if "n_chars" in docs.columns:
        n = F.length("cut").cast(docs.schema["n_chars"].dataType)
        row = F.when(hit, F.col("row").withField("text", F.col("cut")).withField("n_chars", n)).otherwise(F.col("row"))
    return both.select(row.alias("row")).select("row.*")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents")).drop("id")
