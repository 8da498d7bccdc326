"""Chat formatting of reply trees (DataFrame functions only).

Messages form trees: each row names its parent, or none. Root-to-leaf paths are enumerated by
iterative self-joins of fixed-size rows (ids only): a table of jumps to the ancestor 1, 2, 4, ...
steps up, and the set of (leaf, ancestor) rows, which each round extends by the next power of two,
so a tree of depth n takes log2(n) rounds. Branches of a tree are ranked by score, and each chosen
path becomes one conversation.

Template: ``<s>[INST] role [/INST]text</s>`` for each turn. A text may hold such strings itself:
``\\`` is doubled and a ``\\`` goes into each control string after its first character, so that no
control string is left in it; dropping one ``\\`` before any character undoes both.

Cases: null texts and roles are empty; a null tree is a tree of its own; repeated rows are turns of
their own; a parent that is not there makes a root; rows on a cycle have no root and come out nowhere;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import shared_dir, table

TURN, ROLE_END, TURN_END = "<s>[INST] ", " [/INST]", "</s>"
#: The control strings without their first character, which an escaped text has after a "\".
CONTROL = "(<)(s>|/s>)|(\\[)(INST\\]|/INST\\])"


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1$3\\\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def root_to_leaf(nodes: DataFrame) -> DataFrame:
    """(leaf, node, up): each leaf with itself and all its ancestors; ``up`` counts steps from the leaf.

    ``nodes``: node (unique), parent (null: root). All rows are of fixed size; rounds are cut by
    checkpoint(), and stop when no jump is left. On a cycle jumps never end: the rounds stop when
    the jumps have grown past the number of rows, and leaves never reach a cycle.
    """
    shared_dir(nodes.sparkSession)
    nodes = nodes.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    jump = (
        nodes.join(known, "parent", "left")
        .select("node", F.when(F.col("known"), F.col("parent")).alias("above"))
        .checkpoint()
    )
    total = jump.count()
    inner = jump.where("above is not null").select(F.col("above").alias("node")).distinct()
    path = jump.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    while step <= total and not jump.where("above is not null").isEmpty():
        more = path.join(jump.where("above is not null"), "node").select(
            "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up")
        )
        path = path.unionByName(more).checkpoint()
        nxt = jump.select(F.col("node").alias("above"), F.col("above").alias("far"))
        jump = jump.where("above is not null").join(nxt, "above").select("node", F.col("far").alias("above")).checkpoint()
        step *= 2
    return path


def format_reply_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``messages``: tree, node, parent, role, text, score. One row per chosen path.

    Result: tree, leaf, rank, score (mean over the path), n_turns, formatted, loss_spans (start from
    0 and length of each assistant text in ``formatted``, in code points). ``branches``: paths kept
    per tree, best score first, ties to the smaller leaf; None keeps all.
    """
    path = root_to_leaf(messages)
    m = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), "text", "score")
    score = path.join(m.select("node", "tree", "score"), "node").groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.avg("score").alias("score")
    )
    by_score = W.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf")
    ranked = score.withColumn("rank", F.row_number().over(by_score))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    turn = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(ROLE_END))
    turns = path.join(m.select("node", "role", turn.alias("head"), escaped(F.col("text")).alias("body")), "node").select(
        "leaf", F.struct((-F.col("up")).alias("at"), "role", "head", "body").alias("turn")
    )
    told = turns.groupBy("leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns")).join(ranked, "leaf")
    whole = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        span = F.array(F.struct(start.alias("start"), F.length(t["body"]).alias("length")))
        spans = F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct((start + F.length(t["body"]) + len(TURN_END)).alias("at"), spans.alias("spans"))

    return told.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", whole).alias("formatted"),
        F.aggregate("turns", first, walk)["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text): the turns that a formatted conversation tells of."""
    parts = F.split(formatted, TURN_END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), ROLE_END, 1)).alias("role"),
            unescaped(F.substr(p, F.locate(ROLE_END, p) + len(ROLE_END))).alias("text"),
        ),
    )


def threads(rows: DataFrame) -> DataFrame:
    """Conversations given as rows by turn, as messages: each turn replies to the one before it."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = rows.select("conv_id", "turn", "role", "text", key.alias("key"), F.row_number().over(order).alias("i"))
    node = lambda i: F.concat("key", F.lit(":"), i.cast("string"))
    return r.select(
        F.col("conv_id").alias("tree"),
        node(F.col("i")).alias("node"),
        F.when(F.col("i") > 1, node(F.col("i") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    ok = TURN_END + TURN.removeprefix("<s>").strip() + " ok " + ROLE_END.strip()
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ok).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_reply_trees(threads(rows))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(
        "loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    out = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", F.concat_ws("", loss))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", told), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL with the same result as :func:`op5_chat_format`.
ORACLE = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
 UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
 e AS (SELECT *, 22 + length(role) + length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]'))
 + length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) n FROM r)
 SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
 coalesce(length(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant')), 0)::BIGINT loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) loss_sha256, sum(n)::BIGINT formatted_chars FROM e GROUP BY conv_id"""
