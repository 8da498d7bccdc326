"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set is the distinct hashes of its 5-word shingles; documents with equal sets are one
   class, whose smallest doc_id stands for it.
2. A sketch is the k smallest hashes of a set. Inverted lists of the retained values give pairs.
3. Pairs whose union sketch puts their similarity far below the threshold go; the rest are verified
   on full sets: 100 * intersection >= 85 * union.
4. Components of the verified links are found by minimum labels with shortcuts.

Hot values. A list of up to ``list_most`` classes gives all its pairs. A longer list belongs to a
passage that many documents share, or to a large group of near copies. If at least half of a class's
retained values have short lists, every partner of it shares over two thirds of those (a partner
lacks at most 15 % of its set) and is found through them. What is left are classes made mostly of hot
values, and only links between two of them are still open. Most share a passage and have too many
shingles of their own to link at all; those go by an exact bound. The others form groups by runs of
three consecutive retained values. Each member is held against its group's center; members outside
the center's component are then held against all members in other components, inside a join that
gives only links. Within a component no further link can change the result.

A partner exactly at the threshold is missed if none of 32 sampled values (16 in a half-hot class) is
shared, odds below 1e-8; if its estimate from the 32 smallest values of the union falls below the
threshold by ``slack`` or more (fewer than 17 of 32 shared: odds 3.5e-6 at 85 %, 3.3e-5 at 80 %;
sets of up to 32 shingles are estimated exactly); or, between two hot classes, if no run of three
connects their group. Above the threshold the odds fall fast; ``slack=1`` takes the second one away.

Cases: null and empty texts have the empty set and are linked with nothing; a text of fewer than five
words has its whole sequence as its one shingle; a null doc_id is linked with nothing and kept;
repeated rows are members of one class; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import having, in_small_batches, stored, table
from ladderline.llm.hashing import shingles_by_text, slices

SHINGLE_WORDS = 5
SKETCH_SIZE = 32
#: Longest inverted list that gives all its pairs.
LIST_MOST = 40
#: Five standard deviations of an estimate from 32 values at a similarity of 0.85.
ESTIMATE_SLACK = 0.32


def sketches(docs: DataFrame, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                sets = [np.unique(s) for s in shingles_by_text(texts, words)]
                low = [s[:k].view(np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low))),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )
                at += len(texts)

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and the whole set of its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                sets = [np.unique(s).view(np.int64) for s in shingles_by_text(texts, words)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    names=["doc_id", "shingles"],
                )
                at += len(texts)

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, shingles array<long>")


def _alike_in_size(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _list_pairs(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """All pairs (a < b) within each key's rows (rep, n); keys must have bounded lists."""
    member = F.struct("rep", "n")
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("all"))
    each = lists.select("all", F.posexplode("all").alias("i", "m"))
    later = F.filter(F.slice("all", F.col("i") + 2, F.size("all")), lambda x: _alike_in_size(x["n"], F.col("m.n"), percent))
    return each.select(F.col("m.rep").alias("a"), F.explode(later).alias("o")).select("a", F.col("o.rep").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the smallest node that each can reach.

    Each round every node takes the smallest label among its neighbours', then its label's label.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.where("a <> b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = labels.checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        nxt = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "m").alias("m"))
        of = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
        nxt = nxt.join(of, "m").select("node", "component", F.least("m", "up").alias("new")).checkpoint()
        moved = not nxt.where("new <> component").isEmpty()
        labels = nxt.select("node", F.col("new").alias("component"))
        if not moved:
            return labels


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int, slack: float) -> DataFrame:
    """Pairs that the union sketch doesn't rule out. Exact for sets that the sketches hold whole."""
    one = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    two = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    d = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    d = d.withColumn("u", union)
    d = d.withColumn("share", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) / F.size("u"))
    return d.where(F.col("share") >= percent / 100 - slack).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int, name: str) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = having(docs.select("doc_id", "text"), ids, "doc_id")
    sets = stored(full_sets(some, words), f"{name}-sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    d = pairs.join(one, "a").join(two, "b")
    return d.where(_similar(percent)).select("a", "b")


def _similar(percent: int) -> Column:
    """Of rows with sets sa and sb: do they reach the threshold?"""
    common = F.size(F.array_intersect("sa", "sb"))
    return (100 + percent) * common >= percent * (F.size("sa") + F.size("sb"))


def _able_to_link(docs: DataFrame, some: DataFrame, percent: int, words: int, rounds: int = 3) -> DataFrame:
    """Of ``some`` (rep, n, sketch) those that may link with each other, with their full sets and
    ``alone``, how many of their shingles no other has. These can't be in an intersection and are in
    every union, so who has too many of them has no partner here and goes; that makes more shingles
    lonely, so it is done again."""
    ids = some.select(F.col("rep").alias("doc_id"))
    texts = having(docs.select("doc_id", "text"), ids, "doc_id")
    live = full_sets(texts, words).withColumnRenamed("doc_id", "rep").join(some, "rep")
    live = stored(live, "hot-sets")
    for _ in range(rounds):
        lone = live.select("rep", F.explode("shingles").alias("v")).groupBy("v").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
        lone = lone.where("c = 1").groupBy("rep").agg(F.count("*").alias("alone"))
        live = live.drop("alone").join(lone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
        live = stored(live.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), "hot-live")
    return live


def _hot_groups(live: DataFrame) -> DataFrame:
    """``live`` with g, its group: all that three consecutive retained values connect; and the group's
    center, the member with the fewest shingles of its own (a copy that the others were made from)."""
    triple = lambda i: F.xxhash64(F.get("sketch", i), F.get("sketch", i + 1), F.get("sketch", i + 2))
    keys = F.transform(F.sequence(F.lit(0), F.greatest(F.size("sketch") - 3, F.lit(0))), triple)
    keyed = live.select("rep", F.explode(F.array_distinct(keys)).alias("t"))
    first = keyed.groupBy("t").agg(F.min("rep").alias("a"), F.count("*").alias("f")).where("f > 1")
    group = components(keyed.join(first, "t").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
    rows = live.join(group.withColumnRenamed("node", "rep"), "rep").withColumnRenamed("component", "g")
    center = rows.groupBy("g").agg(F.min_by("rep", F.struct(F.col("alone") / F.col("n"), "rep")).alias("center"))
    return stored(rows.join(center, "g").select("g", "center", "rep", "n", "alone", "shingles"), "hot-groups")


def _star_links(grouped: DataFrame, percent: int) -> DataFrame:
    """Links of the members of each group with its center."""
    center = grouped.where("rep = center").select("g", F.col("rep").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
    rest = grouped.where("rep <> center").select("g", F.col("rep").alias("b"), F.col("shingles").alias("sb"), "n")
    return rest.join(center, "g").where(_alike_in_size(F.col("n"), F.col("na"), percent) & _similar(percent)).select("a", "b")


def _straggler_links(grouped: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between members in different components, of each group's members outside its center's
    component with all its members. The bounds and the check on full sets are part of the join, so
    nothing but links comes out of it."""
    of = grouped.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    main = of.where("rep = center").select("g", F.col("c").alias("cc"))
    of = of.join(main, "g").select("g", "rep", "n", "alone", "shingles", "c", (F.col("c") != F.col("cc")).alias("astray"))
    of = stored(of, "hot-members")
    x = of.where("astray").select("g", *[F.col(k).alias(f"{k}_x") for k in ("rep", "n", "alone", "c")], F.col("shingles").alias("sa"))
    y = of.select("g", *[F.col(k).alias(f"{k}_y") for k in ("rep", "n", "alone", "c", "astray")], F.col("shingles").alias("sb"))
    once = ~F.col("astray_y") | (F.col("rep_x") < F.col("rep_y"))
    fits = lambda p, q: 100 * (F.col(f"n_{p}") - F.col(f"alone_{p}")) >= percent * (F.col(f"n_{p}") + F.col(f"alone_{q}"))
    near = _alike_in_size(F.col("n_x"), F.col("n_y"), percent) & fits("x", "y") & fits("y", "x")
    met = x.join(y, "g").where((F.col("c_x") != F.col("c_y")) & once & near & _similar(percent))
    return met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    k: int = SKETCH_SIZE,
    words: int = SHINGLE_WORDS,
    list_most: int = LIST_MOST,
    slack: float = ESTIMATE_SLACK,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = stored(sketches(docs, k, words), "sketches")
    sets = rows.where("doc_id is not null and n_shingles > 0")
    classes = sets.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    reps = stored(classes, "classes")
    exploded = reps.select("rep", "n", F.explode("sketch").alias("v"))
    lengths = exploded.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    listed = exploded.join(lengths, "v")
    listed = stored(listed, "lists")

    pairs = _list_pairs(listed.where(F.col("f") <= list_most), "v", percent).distinct()
    pairs = stored(_estimated(pairs, reps, percent, k, slack), "pairs")
    links = stored(_verified(pairs, docs, percent, words, "first"), "links")
    labels = components(links)

    hot = listed.where(F.col("f") > list_most).groupBy("rep").agg(F.count("*").alias("hot"))
    mostly_hot = reps.join(hot, "rep").where(2 * F.col("hot") > F.size("sketch")).select("rep", "n", "sketch")
    live = _able_to_link(docs, mostly_hot, percent, words)
    if not live.isEmpty():
        grouped = _hot_groups(live)
        more = stored(_star_links(grouped, percent), "star-links")
        labels = components(links.unionByName(more))
        links = links.unionByName(more).unionByName(_straggler_links(grouped, labels, percent))
        labels = components(stored(links, "all-links"))

    labels = stored(labels, "components")
    of_class = reps.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = out.join(of_class, "digest", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    )
    return out.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB SQL with the same result as :func:`op7_near_dedup`: all pairs that share a shingle.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END s FROM d),
 each AS (SELECT doc_id, len(s) n, unnest(s) x FROM sets),
 pairs AS (SELECT a.doc_id p, b.doc_id q, max(a.n) n, max(b.n) m, count(*) k FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT p, q FROM pairs WHERE 100 * k >= 85 * (n + m - k)),
 sym AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
 reach AS (SELECT doc_id a, doc_id b FROM sets UNION SELECT r.a, l.q FROM reach r JOIN sym l ON r.b = l.p)
 SELECT doc_id, len(s)::BIGINT n_shingles, c component_id, doc_id = c kept FROM sets JOIN (SELECT a, min(b) c FROM reach GROUP BY 1) ON doc_id = a"""
