"""Fill-in-middle: texts cut in three at unit boundaries, reordered behind control strings.

Texts of up to ``chunk_bytes`` are cut where they lie, in one scan of an automaton over a batch of
them. A longer text is dealt out as chunks. Each chunk is summed up by its state-transition function
and its marks from every entry state; composing the summaries of a document in order gives each
chunk's entry state and what comes before it, so every chunk finds for itself whether a cut lies in it
and where. Neither the text nor the result of a giant document is ever put together in one place: its
result is one row per piece.

The cuts and the form of a document follow from hashes of its id alone, so a rerun agrees.

Cases: null and empty texts have no unit and stay plain (empty); a null doc_id is hashed as no digits;
a text with a control string stays plain, for it could not be restored; equal cuts leave an empty
middle; repeated rows, and rows that share a doc_id, are each transformed by themselves; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.automaton import RESET, Automaton, marked, minimal, product, string_automaton, summary, unit_automaton
from ladderline.llm.common import in_small_batches, stored, table
from ladderline.llm.hashing import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order of the parts 0 (prefix), 1 (middle) and 2 (suffix), each behind its control string.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
CONTROL = (PREFIX, MIDDLE, SUFFIX)
CHUNK_BYTES = 1 << 20
#: Piece numbers of a giant document are slot * STRIDE + chunk.
STRIDE = 1 << 40

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, row long, piece long, output binary"


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: groups of eight hexadecimal digits of a hash of the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def scanner(units: str) -> Automaton:
    """Marks of kind 0: units begin; of kind 1: control strings end."""
    return minimal(product(unit_automaton(units), string_automaton([s.encode() for s in CONTROL])))


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _joined(parts: list[bytes], form: str) -> bytes:
    return b"".join(CONTROL[p].encode() + parts[p] for p in ORDERS[form])


def _whole(docs: DataFrame, a: Automaton, rate: int, spm: int) -> DataFrame:
    """One row per document, transformed in the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                raw = texts.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
                begin = offsets - offsets[0]
                # a RESET before every text; a position less the texts begun by then is one in ``data``
                starts, hits = marked(a, np.insert(data.astype(np.int32), begin[:-1], RESET))
                shift = begin[:-1] + np.arange(len(texts))
                first = np.searchsorted(starts, shift)
                n = np.diff(np.append(first, len(starts)))
                spoilt = np.diff(np.append(np.searchsorted(hits, shift), len(hits))) > 0
                h = [b.column(2 + i).slice(at, len(texts)).to_pylist() for i in range(4)]
                rows = []
                for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                    units = int(n[i])
                    if not units or spoilt[i] or h[2][i] % 100 >= rate:
                        rows.append((units, "plain", None, None, data[lo:hi].tobytes()))
                        continue
                    form = "spm" if h[3][i] % 100 < spm else "psm"
                    cut = sorted((h[0][i] % (units + 1), h[1][i] % (units + 1)))
                    x, y = [int(starts[first[i] + c]) - i - 1 if c < units else hi for c in cut]
                    parts = [data[lo:x], data[x:y], data[y:hi]]
                    rows.append((units, form, _characters(parts[0]), _characters(parts[1]), _joined([p.tobytes() for p in parts], form)))
                units, form, p, m, out = zip(*rows) if rows else ((),) * 5
                zero = pa.array(np.zeros(len(rows), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)), pa.array(units, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()),
                        pa.array(m, pa.int64()), pa.nulls(len(rows), pa.int64()), zero, pa.array(out, pa.binary()),
                    ],
                    names=[f.split()[0] for f in OUT.split(", ")],
                )
                at += len(texts)

    return in_small_batches(docs).mapInArrow(run, OUT)


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """row (a number for each document), doc_id, h1 to h4, k, data: documents as chunks, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = memoryview(b.column(1)[i].as_buffer())
                for k in range(-(-len(data) // chunk_bytes)):
                    same = [pa.array([b.column(c)[i].as_py()], pa.int64()) for c in (0, 2, 3, 4, 5, 6)]
                    piece = pa.array([bytes(data[k * chunk_bytes : (k + 1) * chunk_bytes])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*same, pa.array([k], pa.int64()), piece], names=["doc_id", "h1", "h2", "h3", "h4", "row", "k", "data"])

    numbered = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("text", F.col("text").cast("binary"))
    schema = "doc_id long, h1 long, h2 long, h3 long, h4 long, row long, k long, data binary"
    return stored(numbered.mapInArrow(run, schema).repartition("row", "k"), "chunks")


def _entered(chunks: DataFrame, a: Automaton) -> DataFrame:
    """row, k, state (that the chunk is entered in), before (units begun before it); and of the document
    n (units), spoilt. Chunks are summed up in parallel, their summaries composed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                end, count = summary(a, np.frombuffer(b.column(2)[i].as_buffer(), np.uint8))
                values = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (end, *count)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *values], names=["row", "k", "ends", "units", "hits"])

    each = chunks.select("row", "k", "data").mapInArrow(run, "row long, k long, ends array<long>, units array<long>, hits array<long>")
    ordered = F.sort_array(F.collect_list(F.struct("k", "ends", "units", "hits")))
    where = "struct<state: bigint, units: bigint, hits: bigint, seen: array<struct<k: bigint, state: bigint, before: bigint>>>"
    start = F.from_json(F.lit('{"state": 0, "units": 0, "hits": 0, "seen": []}'), where)

    def compose(acc: Column, x: Column) -> Column:
        s = (acc["state"] + 1).cast("int")
        here = F.struct(x["k"].alias("k"), acc["state"].alias("state"), acc["units"].alias("before"))
        return F.struct(
            F.element_at(x["ends"], s).alias("state"), (acc["units"] + F.element_at(x["units"], s)).alias("units"),
            (acc["hits"] + F.element_at(x["hits"], s)).alias("hits"), F.concat(acc["seen"], F.array(here)).alias("seen"),
        )

    walked = each.groupBy("row").agg(F.aggregate(ordered, start, compose).alias("w"))
    return walked.select("row", F.col("w.units").alias("n"), (F.col("w.hits") > 0).alias("spoilt"), F.inline("w.seen"))


def _dealt(docs: DataFrame, a: Automaton, rate: int, spm: int, chunk_bytes: int) -> DataFrame:
    """Several rows per document, in order of ``piece``: what the chunks give, and the control strings."""
    chunks = chunked(docs, chunk_bytes)
    n = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("spoilt") | (F.col("h3") % 100 >= rate)
    known = chunks.join(_entered(chunks, a), ["row", "k"]).select(
        "doc_id", "row", "k", "data", "n", "state", "before",
        F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"),
        F.least(F.col("h1") % n, F.col("h2") % n).alias("x"), F.greatest(F.col("h1") % n, F.col("h2") % n).alias("y"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                doc_id, row, k, data, units, state, before, form, x, y = [c[r].as_py() for c in b.columns]
                if form == "plain":
                    parts = [(0, data)]
                else:
                    start = marked(a, np.frombuffer(data, np.uint8), state)[0]
                    # the number of a cut less the units before is its number here; a cut at n is the end
                    x, y = [0 if c < before else int(start[c - before]) if c - before < len(start) else len(data) for c in (x, y)]
                    parts = [(p, d) for p, d in enumerate((data[:x], data[x:y], data[y:])) if d]
                for p, d in parts:
                    slot = 2 * ORDERS[form].index(p) + 1 if form != "plain" else 1
                    got = [doc_id, units, form, row, slot * STRIDE + k, p, _characters(np.frombuffer(d, np.uint8)), d]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(got, kinds)], names=names)

    made = "doc_id long, n long, form string, row long, piece long, part long, chars long, output binary"
    names, kinds = [f.split()[0] for f in made.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    pieces = stored(known.mapInArrow(cut, made), "cut-chunks")
    in_part = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("chars"))), F.lit(0))
    sums = pieces.where("form <> 'plain'").groupBy("row").agg(in_part(0).alias("prefix_chars"), in_part(1).alias("middle_chars"), F.first("form").alias("form"), F.first("doc_id").alias("doc_id"), F.first("n").alias("n"))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "row", "piece", "output"]
    texts = pieces.join(sums.select("row", "prefix_chars", "middle_chars"), "row", "left").select(*columns)
    control = lambda form: F.array(*[
        F.struct(F.lit(2 * i * STRIDE).alias("piece"), F.lit(CONTROL[p]).cast("binary").alias("output")) for i, p in enumerate(ORDERS[form])
    ])
    signs = sums.select("*", F.inline(F.when(F.col("form") == "psm", control("psm")).otherwise(control("spm")))).select(*columns)
    return texts.unionByName(signs)


def transformed(docs: DataFrame, seed: int, rate: int, spm: int, units: str, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Results of documents of up to ``chunk_bytes``, and of the longer ones."""
    a = scanner(units)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *_draws(F.col("doc_id"), seed))
    big = F.octet_length("text") > chunk_bytes
    return _whole(rows.where(~big), a, rate, spm), _dealt(rows.where(big), a, rate, spm, chunk_bytes)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, units: str = "lines", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, row, piece, output.

    ``rate`` of 100 documents are reordered, ``spm`` of 100 of them with the suffix first. A document of
    up to ``chunk_bytes`` is one row with ``row`` null and its whole output; of a longer one the rows that
    share a ``row``, in order of ``piece``, are its output, and no control string crosses two of them.
    """
    whole, dealt = transformed(docs, seed, rate, spm, units, chunk_bytes)
    return whole.unionByName(dealt)


def restored(output: Column, form: Column) -> Column:
    """The text of a whole output: what stands behind each control string, in the order of the text."""
    text = output.cast("string")
    place = {f: [o.index(p) + 1 for p in range(3)] for f, o in ORDERS.items()}
    order = F.when(form == "psm", F.array(*map(F.lit, place["psm"]))).when(form == "spm", F.array(*map(F.lit, place["spm"])))
    joined = lambda parts: F.array_join(F.transform(order, lambda i: F.get(parts, i)), "")
    return F.when(form == "plain", text).otherwise(F.get(F.transform(F.array(F.split(text, "<[PSM]>", 4)), joined), 0))


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces of giant documents in the order of their texts: row, at, data. A piece belongs to the
    control string that stands before it in the output."""
    sign, text = F.col("output").cast("string"), pieces.where("form = 'plain'").select("row", "piece", F.lit(0).alias("part"), "output")
    moved = pieces.where("form <> 'plain'")
    is_sign = (F.octet_length("output") == 3) & sign.isin(*CONTROL)
    place = moved.where(is_sign).groupBy("row").agg(*[F.max(F.when(sign == c, F.col("piece"))).alias(f"p{i}") for i, c in enumerate(CONTROL)])
    behind = lambda i: F.when(F.col(f"p{i}") < F.col("piece"), F.struct(F.col(f"p{i}").alias("at"), F.lit(i).alias("part")))
    part = F.greatest(*[behind(i) for i in range(3)])["part"]
    back = moved.where(~is_sign).join(place, "row").select("row", "piece", part.alias("part"), "output")
    return text.unionByName(back).select("row", (F.col("part") * 16 * STRIDE + F.col("piece")).alias("at"), F.col("output").alias("data"))


def _digests(pieces: DataFrame, at: str, data: str, name: str) -> DataFrame:
    """(row, sha256 of its pieces in order): a stream over sorted pieces, one of them in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, h = None, None
        say = lambda: pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([h.hexdigest()])], names=["row", name])
        for b in batches:
            for r, d in zip(b.column(0).to_pylist(), b.column(1)):
                if r != row or h is None:
                    if h is not None:
                        yield say()
                    row, h = r, hashlib.sha256()
                h.update(d.as_buffer())
        if h is not None:
            yield say()

    ordered = pieces.repartition("row").sortWithinPartitions("row", at).select("row", data)
    return ordered.mapInArrow(run, f"row long, {name} string")


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, units: str = "lines", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document its figures and the sha256 of its output and of the text restored from that."""
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    whole, pieces = transformed(docs, seed, rate, spm, units, chunk_bytes)
    back = restored(F.col("output"), F.col("form")).cast("binary")
    whole = whole.select(*columns, F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
    heads = pieces.groupBy("row").agg(*[F.first(c).alias(c) for c in columns])
    dealt = heads.join(_digests(pieces, "piece", "output", "output_sha256"), "row").join(_digests(restored_pieces(pieces), "at", "data", "restored_sha256"), "row")
    return whole.unionByName(dealt.select(*whole.columns))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: DuckDB SQL with the same result as :func:`op12_fill_in_middle`.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
 u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') l, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT for i in range(4)] x FROM d),
 c AS (SELECT *, len(l) n, least(x[1] % (len(l) + 1), x[2] % (len(l) + 1)) p, greatest(x[1] % (len(l) + 1), x[2] % (len(l) + 1)) m,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END form FROM u),
 s AS (SELECT *, array_to_string(l[1:p], '') a, array_to_string(l[p + 1:m], '') b, array_to_string(l[m + 1:], '') z FROM c),
 o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END out FROM s),
 r AS (SELECT *, string_split_regex(out, '<[PSM]>') k FROM o)
 SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT middle_chars,
 sha256(out) output_sha256, sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN k[2] || k[4] || k[3] ELSE k[3] || k[4] || k[2] END) restored_sha256 FROM r"""
