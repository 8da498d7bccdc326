"""Packing by best-fit decreasing.

Overlong documents are first cut into full windows. The rests go, longest first, into the open
window with the tightest room, which a segment tree over remaining capacities finds in log(capacity)
steps. Windows stay as best fit leaves them, but for the emptiest one of a batch: it is laid out as
windows whose lengths are powers of two, which need no padding.

Documents are packed in the tasks that tokenize them, a bounded number of tokens at a time, so
nothing is shuffled and memory doesn't grow with the input. A window's number holds the task's
partition and a count, so windows of different tasks never meet.

Cases: a null or empty text is one piece (its end id); repeated rows are packed one by one; a null
doc_id is carried along; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import in_small_batches, table
from ladderline.llm.tokens import encoder

CAPACITY = 2048
BATCH_TOKENS = 1_500_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Counts of open windows by remaining capacity, as a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity that is at least ``need``."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1 and (i & 1 or not self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows, each a list of indexes into ``lengths`` (all between 1 and ``capacity``)."""
    tree, by_room, windows = RoomTree(capacity), defaultdict(list), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        room = tree.tightest(n)
        if room is None:
            w, left = len(windows), capacity - n
            windows.append([i])
        else:
            w, left = by_room[room].pop(), room - n
            tree.add(room, -1)
            windows[w].append(i)
        if left:
            tree.add(left, 1)
            by_room[left].append(w)
    return windows


def pack(lengths: Iterable[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length). At most ``capacity`` ids each; every id once."""
    out, rests = [], []
    for d, n in enumerate(lengths):
        cut = n - n % capacity
        out += [[(d, s, capacity)] for s in range(0, cut, capacity)]
        if n % capacity:
            rests.append((d, cut, n % capacity))
    windows = [[rests[i] for i in w] for w in best_fit_decreasing([r[2] for r in rests], capacity)]
    used = [sum(p[2] for p in w) for w in windows]
    emptiest = min(range(len(windows)), key=used.__getitem__, default=None)
    rest, left = [], 0
    if emptiest is not None and used[emptiest] < capacity:
        rest, left = windows.pop(emptiest), used[emptiest]
    out += windows
    while left:
        size = 1 << (left.bit_length() - 1)
        w, need = [], size
        while need:
            d, s, n = rest.pop()
            take = min(n, need)
            w.append((d, s, take))
            need -= take
            if n > take:
                rest.append((d, s + take, n - take))
        out.append(w)
        left -= size
    return out


def _emit(ids: list, parts: list[np.ndarray], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    sizes = [len(p) for p in parts]
    windows = pack(sizes, capacity)
    rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
    for k, w in enumerate(windows):
        offset = 0
        for d, s, n in w:
            for name, v in zip(rows, (ids[d], s, n, parts[d][s : s + n].tobytes(), sizes[d], first + k, offset)):
                rows[name].append(v)
            offset += n
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows)), first + len(windows)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    space_prefix: bool = True,
    end_id: int = 1,
    capacity: int = CAPACITY,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """One row per piece: ``ids`` are little-endian unsigned 32-bit token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, space_prefix, end_id)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        for b in batches:
            doc_ids, at = b.column(0).to_pylist(), 0
            for n, flat, lengths in e.encode(b.column(1)):
                ids += doc_ids[at : at + n]
                parts += np.split(flat.astype("<u4", copy=False), np.cumsum(lengths)[:-1])
                at, held = at + n, held + len(flat)
                if held >= batch_tokens:
                    out, number = _emit(ids, parts, number, capacity)
                    yield out
                    ids, parts, held = [], [], 0
        if ids:
            yield _emit(ids, parts, number, capacity)[0]

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
