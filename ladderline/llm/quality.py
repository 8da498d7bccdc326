"""Quality rules by distribution divergence (DataFrame functions only).

Each language has a reference made from all its documents: how their characters divide into classes,
and how often its common words come, which are those that come most often in all its documents. A
document is held against the reference of its language by the Jensen-Shannon distance (base 2, between
0 and 1) of both histograms. Texts below a minimum length have noisy histograms, so guards leave the
distances without a vote.

Words are counted before anything is shuffled, each task ranks its own before the last one does, and
what is counted in a text is stored, a short row per document; both the references and the verdicts are
made from those rows.

Cases: a null text has no words and fails the base rules; a null ``lang`` is a language of its own, and
so is an empty one; a language without words has no word distance; words that come as often go in order
of code points; repeated rows are judged one by one; an empty table gives an empty result; columns other
than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import stored, table, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "lower", "digit", "space", "symbol", "other")
#: Tables with a row per language are broadcast up to so many rows.
MOST_LANGUAGES = 100_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: How many of a language's most frequent words count.
    common_words: int = 16
    #: Distances vote from these lengths on.
    min_chars_for_classes: int = 200
    min_words_for_common: int = 50
    max_class_distance: float = 0.27
    max_word_distance: float = 0.45


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once: a lambda's variable is, an expression used twice isn't."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more.

    Windows are compared by 64-bit hash. Sorting (hash, position) brings equal windows together, so
    the cost is n log n; the sort runs only where a text has fewer distinct windows than windows.
    """
    hashes = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )

    def positions(o: Column) -> Column:
        alike = lambda e, j: F.coalesce(F.get(o, j)["h"] == e["h"], F.lit(False))
        hit = F.filter(o, lambda e, j: F.when(j > 0, alike(e, j - 1)).otherwise(False) | alike(e, j + 1))
        return F.sort_array(F.transform(hit, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def many(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda o: let(positions(o), covered))

    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(many(h))
    return let(hashes, count).cast("long")


def _language() -> Column:
    """A key that null has as well, apart from every value."""
    return F.when(F.col("lang").isNull(), "n").otherwise(F.concat(F.lit("l"), "lang"))


def _per_language(rows: DataFrame, name: str) -> DataFrame:
    """A table with a row per language, broadcast if it is small."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else rows


def common_words(docs: DataFrame, most: int) -> DataFrame:
    """language and ``common``, the words that come most often in all its documents."""
    d = docs.select(_language().alias("language"), F.explode(words(F.col("text"))).alias("word"))
    by_word = d.groupBy("language", "word").agg(F.count("*").alias("n"))
    ranked = by_word.withColumn("r", F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "word")))
    top = ranked.where(F.col("r") <= most).groupBy("language").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("top"))
    return top.select("language", F.transform("top", lambda x: x["word"]).alias("common"))


def word_counts(w: Column, common: Column) -> Column:
    """How often each of the words ``common`` comes, then all other words; null without ``common``."""

    def counts(hits: Column) -> Column:
        each = F.transform(common, lambda c: F.size(F.filter(hits, lambda x: x == c)).cast("long"))
        return let(each, lambda e: F.concat(e, F.array(F.size(w) - total(e))))

    return let(F.filter(w, lambda x: F.array_contains(common, x)), counts)


def measured(docs: DataFrame, rules: Rules) -> DataFrame:
    """One short row per document with all that the rules count in its text."""
    d = docs.select("doc_id", _language().alias("language"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.join(_per_language(common_words(docs, rules.common_words), "common-words"), "language", "left")
    # "rest" is what neither letters nor separators leave: short, so counting in it costs little
    d = d.withColumns({"w": words(F.col("t")), "rest": F.regexp_replace("t", "[\\p{L}\\x20\\x09-\\x0D]+", "")})
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.length("rest") - F.length(F.regexp_replace("rest", "[#*$%&|<>]+", ""))
    digits = F.length("rest") - F.length(F.regexp_replace("rest", "\\p{Nd}+", ""))
    upper = F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}+", ""))
    d = d.select(
        "doc_id",
        "language",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.length("t").alias("n_chars"),
        F.length("rest").alias("n_rest"),
        symbols.alias("n_symbols"),
        digits.alias("n_digits"),
        upper.alias("n_upper"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        word_counts(F.col("w"), F.col("common")).alias("word_counts"),
    )
    c = {x: F.col(x).cast("long") for x in ("n_words", "word_chars", "n_chars", "n_rest", "n_symbols", "n_digits", "n_upper", "n_dup_lines")}
    classes = F.array(
        c["n_upper"],
        c["word_chars"] - c["n_rest"] - c["n_upper"],
        c["n_digits"],
        c["n_chars"] - c["word_chars"],
        c["n_symbols"],
        c["n_rest"] - c["n_symbols"] - c["n_digits"],
    )
    keep = ("n_words", "word_chars", "n_chars", "n_symbols", "n_dup_lines")
    return d.select("doc_id", "language", *[c[x].alias(x) for x in keep], "n_repeat_words", classes.alias("class_counts"), "word_counts")


def shares(counts: Column) -> Column:
    return let(total(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histograms of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(rows: DataFrame, rules: Rules) -> DataFrame:
    """A row per language: class_ref and word_ref, the shares over all its documents."""
    at = lambda c, i: F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0))
    sums = rows.groupBy("language").agg(
        F.array(*[at("class_counts", i) for i in range(len(CLASSES))]).alias("c"),
        F.array(*[at("word_counts", i) for i in range(rules.common_words + 1)]).alias("w"),
    )
    return sums.select("language", shares(F.col("c")).alias("class_ref"), shares(F.col("w")).alias("word_ref"))


def score_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: its counts, both distances, ``base_failed`` and ``kept``."""
    rows = stored(measured(docs, rules), "quality")
    d = rows.join(_per_language(references(rows, rules), "references"), "language")
    ref = F.slice("word_ref", F.lit(1), F.size("word_counts"))
    d = d.withColumn("class_distance", F.round(js_distance(shares(F.col("class_counts")), F.col("class_ref")), 6))
    d = d.withColumn("word_distance", F.round(js_distance(shares(F.col("word_counts")), ref), 6))
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    odd = (
        (F.col("n_chars") >= rules.min_chars_for_classes) & (F.col("class_distance") > rules.max_class_distance)
    ) | ((F.col("n_words") >= rules.min_words_for_common) & (F.col("word_distance") > rules.max_word_distance))
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        base.alias("base_failed"),
        (~base & ~F.coalesce(odd, F.lit(False))).alias("kept"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def oracle(rules: Rules = Rules()) -> str:
    """DuckDB SQL with the same result as :func:`op10_quality_rules`."""
    n = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(p: str, q: str) -> str:
        a, b = f"{p}[i]", f"{q}[i]"
        return f"round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(a, b)} + {part(b, a)}) / 2)), 0)), 6)"

    share = lambda x: f"list_transform({x}, lambda z: CASE WHEN list_sum({x}) > 0 THEN z / list_sum({x})::DOUBLE ELSE 0 END)"
    ref = lambda x, out: f"{out} AS (SELECT lang, {share('c')} r FROM (SELECT lang, list(n ORDER BY i) c FROM (SELECT lang, i, sum(n) n FROM (SELECT lang, unnest({x}) n, generate_subscripts({x}, 1) i FROM e) GROUP BY 1, 2) GROUP BY 1))"
    return rf"""WITH d AS (SELECT row_number() OVER () k, doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'l' || lang END lang, coalesce(text, '') t,
 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines FROM documents),
 p AS (SELECT k, unnest(w) a, generate_subscripts(w, 1) i FROM d),
 three AS (SELECT k, i, a, lead(a) OVER (PARTITION BY k ORDER BY i) b, lead(a, 2) OVER (PARTITION BY k ORDER BY i) c FROM p),
 many AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) m FROM three WHERE c IS NOT NULL) WHERE m > 1),
 covered AS (SELECT k, count(DISTINCT i + o) n FROM many, (VALUES (0), (1), (2)) v(o) GROUP BY k),
 often AS (SELECT lang, list(a ORDER BY r) listed FROM (SELECT lang, a, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, a) r FROM p JOIN d USING (k) GROUP BY lang, a) WHERE r <= {rules.common_words} GROUP BY lang),
 m AS (SELECT d.*, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, length(t)::BIGINT n_chars, ({n('[#*$%&|<>]')})::BIGINT n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(covered.n, 0)::BIGINT n_repeat_words, {n(chr(92) + 'p{Lu}')} u, {n(chr(92) + 'p{L}')} l, {n(chr(92) + 'p{Nd}')} g,
 list_transform(listed, lambda c: len(list_filter(w, lambda x: x = c))) h FROM d LEFT JOIN covered USING (k) LEFT JOIN often USING (lang)),
 e AS (SELECT *, [u, l - u, g, n_chars - word_chars, n_symbols, word_chars - l - g - n_symbols] cc, CASE WHEN h IS NOT NULL THEN list_append(h, len(w) - list_sum(h)) END wc FROM m),
 {ref('cc', 'cr')}, {ref('wc', 'wr')},
 s AS (SELECT e.*, {share('cc')} cs, {share('wc')} ws, cr.r qc, wr.r qw FROM e JOIN cr USING (lang) LEFT JOIN wr USING (lang)),
 f AS (SELECT *, {distance('cs', 'qc')} class_distance, CASE WHEN ws IS NOT NULL THEN {distance('ws', 'qw')} END word_distance,
 n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words base_failed FROM s)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed,
 NOT base_failed AND NOT coalesce((n_chars >= {rules.min_chars_for_classes} AND class_distance > {rules.max_class_distance})
 OR (n_words >= {rules.min_words_for_common} AND word_distance > {rules.max_word_distance}), false) kept FROM f"""
