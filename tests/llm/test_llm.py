"""The training-data operators against brute force, exact round trips and edge cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import ann, chat, langid, linear, mixing, near_dedup, packing, quality, substring_dedup, token_orc, toxicity
from ladderline.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ODD = [
    (None, "a row without an id", "en", "s", 1, "x"),
    (900, None, None, None, None, None),
    (901, "", "en", "s", 0, "x"),
    (902, " \t\n ", "en", None, 4, "x"),
    (903, "one two", "en", "s", 7, "x"),
    (903, "one two", "en", "s", 7, "x"),
    (904, "the " * 3000 + "end", "en", "s", 12003, "x"),
    (905, "ÄÖ <|endoftext|> é  \n", "de", "t", 20, "x"),
]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 200)), "en", f"s{i % 5}", 0, "x") for i in range(60)]
    base = prose(rng, 200).split()
    for i in range(60, 80):  # near copies, some beyond the threshold
        w = list(base)
        for _ in range(i - 60):
            w[rng.randrange(200)] = "zz"
        rows.append((i, " ".join(w), "en", "s0", 0, "x"))
    shared = prose(rng, 70)
    for i in range(80, 90):
        rows.append((i, f"{prose(rng, 40)} {shared} {prose(rng, 40)}", "en", "s1", 0, "x"))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("list_most", [40, 3])
def test_near_duplicates_are_exact(docs, texts, list_most):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, list_most=list_most).collect()}
    sets = {t[0]: shingles(t[1]) for t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (len(s), root(i), root(i) == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()]
    assert (None, 1, None, True) in got and (900, 0, 900, True) in got and (901, 0, 901, True) in got
    assert got.count((903, 1, 903, True)) == 2 and near_dedup.near_duplicates(none).count() == 0


def test_passages_are_found_and_cut(docs, odd, none):
    found = {r.doc_id: r for r in substring_dedup.passages(docs).collect()}
    for i in range(81, 90):
        r = found[i]
        assert r.start <= 40 and r.start + r.n_words >= 110 and 80 in r.source_ids
    assert 80 not in found and not any(i < 60 for i in found)
    left = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs, substring_dedup.passages(docs)).collect()}
    assert len(WORD.findall(left[80])) == 150 and 75 <= len(WORD.findall(left[85])) <= 80
    assert substring_dedup.passages(none).count() == 0
    assert substring_dedup.remove_passages(odd, substring_dedup.passages(odd)).count() == len(ODD)


def test_chains_are_best_and_alignment_counts():
    i, j, n = np.array([0, 5, 10, 12, 15]), np.array([0, 5, 90, 10, 15]), np.ones(5, int)
    best = substring_dedup.chains(i, j, n)[0]
    assert best.tolist() == [0, 1, 3, 4]
    a = list(range(100, 140))
    b = [*a[:20], 7, *a[21:]]
    assert substring_dedup.align(a, b, [(5, 5, 5), (30, 30, 5)]) == (0, 40, 0, 40, 39)


def test_chains_against_all_pairs():
    rng = random.Random(12)
    for _ in range(300):
        at = sorted((rng.randrange(60), rng.randrange(60), rng.randint(1, 4)) for _ in range(rng.randint(1, 12)))
        i, j, n = (np.array(x) for x in zip(*at))
        score = []
        for c, (x, y, m) in enumerate(at):
            own = 5 * m - 0.2 * (m - 1)
            before = [score[p] - 0.1 * (x - u - k + 1 + y - v - k + 1) for p, (u, v, k) in enumerate(at[:c]) if u + k <= x and v + k <= y]
            score.append(own + max([0.0, *before]))
        best = substring_dedup.chains(i, j, n)[0]
        total = sum(5 * m - 0.2 * (m - 1) for m in n[best])
        total -= sum(0.1 * (i[q] - i[p] - n[p] + 1 + j[q] - j[p] - n[p] + 1) for p, q in zip(best, best[1:]))
        assert total == pytest.approx(max(score)) and sorted(x for c in substring_dedup.chains(i, j, n) for x in c) == list(range(len(at)))


def test_runs_in_common_against_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for d in range(60):  # few words, so that seeds repeat within and between documents
        rows.append((d * 7 % 61, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))))
    first, want = {}, set()
    for d, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - 4):
            first.setdefault(tuple(w[p : p + 5]), (d, p))
    for d, t in rows:
        w = t.split()
        for p in range(len(w) - 4):
            o, q = first[tuple(w[p : p + 5])]
            if o != d:
                want.add((d, o, p, q))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for flush, bucket in ((10**6, 10**6), (100, 40), (700, 300)):
        got = set()
        for r in substring_dedup.chained(df, flush_seeds=flush, bucket_seeds=bucket).collect():
            for x, y, n in zip(r.xs, r.ys, r.ns):
                got |= {(r.doc_id, r.owner, r.a + x + s, r.b + y + s) for s in range(n - 4)}
        assert got == want


def test_edit_matches_against_brute_force():
    def brute(a, b):
        best = {}
        for x in range(len(a), -1, -1):
            for y in range(len(b), -1, -1):
                ways = [] if x < len(a) or y < len(b) else [(0, 0)]
                if x < len(a):
                    ways.append((best[x + 1, y][0] + 1, best[x + 1, y][1]))
                if y < len(b):
                    ways.append((best[x, y + 1][0] + 1, best[x, y + 1][1]))
                if x < len(a) and y < len(b):
                    e, m = best[x + 1, y + 1]
                    ways.append((e, m - 1) if a[x] == b[y] else (e + 1, m))
                best[x, y] = min(ways)
        return -best[0, 0][1]

    rng = random.Random(14)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        assert substring_dedup._edit_matches(a, b) == brute(a, b)


def test_rows_that_share_an_id_are_cut_by_their_own_passages(spark):
    rng = random.Random(15)
    shared, own = prose(rng, 120), prose(rng, 130)
    rows = [(1, f"{shared} \t\n", "a"), (2, shared, "b"), (2, own, "c"), (2, shared, "d"), (None, f"{own} x", "e"), (None, "lone", "f"), (3, f"head  {shared}\n tail  ", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `spans` string").withColumns({"row": F.lit(1), "id": F.lit(2), "cut": F.lit(3), "doc": F.lit("x")})
    found = substring_dedup.passages(df)
    left = sorted((r.spans, r.text) for r in substring_dedup.remove_passages(df, found).select("spans", "text").collect())
    # hashed ids come before doc_ids; of rows c and e, which share a passage, the one with the smaller id keeps it
    assert [x for x, _ in left] in (["b", "c", "d", "e", "f", "g"], ["b", "d", "e", "f", "g"])
    texts = dict(left)
    assert texts["g"] == "head\n tail  " and texts["f"] == "lone"


def test_a_long_text_with_a_long_passage(spark):
    rng = random.Random(16)
    long = prose(rng, 200_000)  # over a megabyte
    df = spark.createDataFrame([(1, long), (2, f"{prose(rng, 60)} {long}"), (3, " " * 1_000_000)], "doc_id long, text string")
    found = substring_dedup.passages(df)
    r = found.collect()
    assert [(x.doc_id, x.start, x.n_words, x.source_ids) for x in r] == [(2, 60, 200_000, [1])]
    left = {x.doc_id: x.text for x in substring_dedup.remove_passages(df, found).collect()}
    assert len(WORD.findall(left[2])) == 60 and left[3] == " " * 1_000_000 and left[1] == long


@pytest.mark.parametrize("passage,own", [(100, 100), (60, 40), (300, 100)])
def test_two_shared_passages_with_own_text_between(spark, passage, own):
    rng = random.Random(passage)
    head, foot = prose(rng, passage), prose(rng, passage)
    df = spark.createDataFrame([(i, f"{head} {prose(rng, own)} {foot}") for i in (1, 2)], "doc_id long, text string")
    found = substring_dedup.passages(df).orderBy("start").collect()
    want = [(0, passage), (passage + own, passage)]
    assert [r.doc_id for r in found] == [2, 2]
    assert all(abs(r.start - s) <= 2 and abs(r.n_words - n) <= 2 for r, (s, n) in zip(found, want))


@pytest.mark.parametrize("every", [6, 7, 8])
def test_fuzzy_passages_are_found(spark, every):
    rng = random.Random(every)
    rows, share = [], []
    for i in range(40):  # 60 words, one changed in so many
        one, at = prose(rng, 60).split(), rng.randrange(every)
        two = [f"zz{i}x{x}" if x % every == at else w for x, w in enumerate(one)]
        share.append(sum(x == y for x, y in zip(one, two)) / 60)
        rows += [(d, f"{prose(rng, 60)} {' '.join(w)} {prose(rng, 60)}") for d, w in ((i, one), (100 + i, two))]
    assert min(share) >= substring_dedup.SIMILARITY
    found = {r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(found) == list(range(100, 140))
    assert all(r.start >= 55 and 50 <= r.n_words <= 65 and r.source_ids == [d - 100] for d, r in found.items())


def test_stretches_of_a_chain():
    a = list(range(1000, 1100))
    b = [*a[:30], *range(12), *a[30:60], *range(50), *a[60:]]
    at = [(0, 0, 30), (30, 42, 30), (60, 122, 40)]
    # 30 + 30 words with 12 put in reach 0.8, all together don't
    assert substring_dedup.stretches(a, b, at) == [(0, 60, 0, 72, 60), (60, 100, 122, 162, 40)]
    assert substring_dedup.stretches(a, a, [(0, 0, 40), (45, 45, 10), (60, 60, 30)]) == [(0, 100, 0, 100, 100)]


@pytest.mark.parametrize("name, space_prefix", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_tokenizers_own(name, space_prefix):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = [*"ab 's\n\t .,<|>$12ΣσéÉAIİ", "́", "̇", " ", "　", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "  ", "it's"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", None]
    plain = ["Straße", "and", "ñoÿ", "ÉTÉ", ".", ",;", "!?", "\n", " ", " ", "don't", "\n\n", "x", "ı", "é́"]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    e = Encoder(public_tokenizers.path(name), space_prefix, 1, max_pieces=50)
    assert e.direct
    own = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids + [1] for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    # a slice, and what a cast makes of one, whose offsets don't begin at 0
    whole = pa.array(texts)
    for part, ids in ((whole, want), (whole.slice(2500, 2000), want[2500:4500]), (whole.slice(7, 900).cast(pa.large_string()), want[7:907])):
        assert [x.tolist() for n, flat, lengths in e.encode(part) for x in np.split(flat, np.cumsum(lengths)[:-1])] == ids


def test_packing_covers_every_id_once():
    rng = random.Random(2)
    for n in (0, 1, 2, 50, 400):
        lengths = [rng.choice([1, 3, 60, 700, 2048, 5000]) + rng.randint(0, 9) for _ in range(n)]
        seen = {}
        for w in packing.pack(lengths):
            assert sum(p[2] for p in w) <= 2048
            for d, s, k in w:
                seen.setdefault(d, []).append((s, k))
        for d, size in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[d]):
                assert s == at
                at += k
            assert at == size
    lengths = [rng.randint(1, 300) ** 2 // 30 + 1 for _ in range(2000)]
    totals = [sum(p[2] for p in w) for w in packing.pack(lengths)]
    assert sum(2048 - t for t in totals if t & (t - 1)) <= 0.001 * sum(lengths)


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        lengths, windows = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))], []
        for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [w for w in windows if w[0] >= lengths[i]]
            if fits:
                best = min(fits, key=lambda w: w[0])
                best[0] -= lengths[i]
                best[1].append(i)
            else:
                windows.append([100 - lengths[i], [i]])
        got = packing.best_fit_decreasing(lengths, 100)
        rooms = lambda ws: sorted(100 - sum(lengths[i] for i in w) for w in ws)
        assert rooms(got) == sorted(w[0] for w in windows) and sorted(i for w in got for i in w) == list(range(len(lengths)))


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit_decreasing([60, 50, 40, 35], 100) == [[0, 2], [1, 3]]
    t = packing.RoomTree(2048)
    for room in (5, 100, 2000):
        t.add(room, 1)
    assert [t.tightest(x) for x in (1, 5, 6, 101, 2001)] == [5, 5, 100, 2000, None]


def test_packed_and_written_ids_of_odd_rows(spark, odd, none, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path).collect()
    assert sum(r.length for r in rows if r.doc_id == 903) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 903)
    assert [r.length for r in rows if r.doc_id == 900] == [1] and packing.pack_documents(none, path).count() == 0
    token_orc.write_tokens(odd, f"{tmp_path}/orc", path, True)
    got = token_orc.with_crc32(token_orc.read_tokens(spark, f"{tmp_path}/orc")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda x: -1 if x is None else x)
    assert got[1].ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes()) and got[-1].start == sum(r.n_tokens for r in got[:-1])
    one = token_orc.read_tokens(spark, f"{tmp_path}/orc").where("doc_id = 901")
    assert one.count() == 1 and "isnotnull(doc_id" in one._jdf.queryExecution().executedPlan().toString()
    many = spark.range(45_000).select((2 * F.col("id")).alias("doc_id"), F.lit("word").alias("text")).repartition(1)
    token_orc.write_tokens(many, f"{tmp_path}/many", path, True)

    def rows_read(doc_id):
        df = spark.read.schema(token_orc.SCHEMA).orc(f"{tmp_path}/many").where(F.col("doc_id") == doc_id)
        found, plan = len(df.collect()), df._jdf.queryExecution().executedPlan()
        assert f"EqualTo(doc_id,{doc_id})" in plan.toString()
        return found, sum(plan.collectLeaves().apply(i).metrics().apply("numOutputRows").value() for i in range(plan.collectLeaves().size()))

    found, read = rows_read(40_000)
    assert found == 1 and read <= 10_000  # one row group by its index
    assert rows_read(40_001) == (0, 0)  # within every range of values: the Bloom filter tells
    token_orc.write_tokens(none, f"{tmp_path}/empty", path, True)
    assert token_orc.read_tokens(spark, f"{tmp_path}/empty").count() == 0


def test_mix_comes_near_its_targets(docs, odd, none):
    plan = mixing.mix(docs, block=8).toPandas()
    assert (plan["taken"] <= 3 * plan["size"]).all() and abs(plan.groupby("source")["target"].first().sum() - plan["size"].sum()) < 1e-6
    for _, g in plan.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.03 * g["target"].iloc[0] + 16
    again = mixing.mix(docs, block=8).toPandas()
    assert sorted(map(str, plan.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.mixed_documents(docs, mixing.mix(docs, block=8)).collect())
    assert words == plan["taken"].sum()


@pytest.mark.parametrize("sizes", [(1000, 10, 40), (200_000, 3, 900, 70), (50, 50)])
def test_every_source_comes_near_its_target(spark, sizes):
    rng = random.Random(17)
    rows = []
    for s, n in enumerate(sizes):
        while n:
            k = min(n, rng.randint(1, 400))
            rows.append((len(rows), "w " * k, f"s{s}"))
            n -= k
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (plan["taken"] <= 3 * plan["size"]).all()
    for _, g in plan.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.005 * g["target"].iloc[0] + 1


def test_shards_by_groups_and_shared_ids(spark, docs, odd):
    few = mixing.mix(docs, shard_words=300, group_shards=3, fine_below=1).toPandas()
    for _, g in few.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.05 * g["target"].iloc[0] + 64
    both = odd.unionByName(odd.where("doc_id = 903")).withColumns({c: F.lit(1) for c in ("row", "times", "spans", "id", "taken", "times_", "spans_", "block")})
    plan = mixing.mix(both)
    got = mixing.mixed_documents(both, plan)
    assert got.columns == both.columns
    assert sum(len(WORD.findall(r.text)) for r in got.collect()) == plan.agg(F.sum("taken")).first()[0]


def test_sainte_lague_and_targets():
    def brute(votes, seats):
        got = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
            got[i] += 1
        return got

    rng = random.Random(3)
    for _ in range(50):
        votes = [rng.choice([0, 1, 10, 53, 53, 1000]) for _ in range(rng.randint(1, 6))]
        if any(votes):
            seats = rng.randint(0, 60)
            assert mixing.sainte_lague(votes, seats) == brute(votes, seats)
    assert mixing.capped_targets([10, 1000, 990], [5, 2, 1], 2000, 3) == [30, pytest.approx(1970 * 2 / 3), pytest.approx(1970 / 3)]


def test_conversations_come_back(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", " [/INST]", "\\", "\n", "ok", "[", "<", "\\s", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) if rng.random() > 0.1 else None) for c in (*range(12), None) for t in range(1 + (c or 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_reply_trees(chat.threads(df)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(out) == 13
    for r in out:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.tree]
        assert [tuple(t) for t in r.turns] == want
        loss = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in loss] == [t for role, t in want if role == "assistant"]


def test_branches_of_reply_trees(spark):
    rows = [(1, "a", None, "user", "q", 1.0), (1, "b", "a", "assistant", "bad", 0.1), (1, "c", "a", "assistant", "good", 0.9), (1, "d", "c", "user", "more", 0.9)]
    df = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double")
    got = {r.leaf: r for r in chat.format_reply_trees(df, None).collect()}
    assert set(got) == {"b", "d"} and got["d"].rank == 1 and got["d"].n_turns == 3 and got["b"].rank == 2
    assert [r.leaf for r in chat.format_reply_trees(df).collect()] == ["d"]
    assert chat.format_reply_trees(df.limit(0)).count() == 0


def test_quality_counts(odd, none, docs, texts):
    got = quality.score_quality(odd.unionByName(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert by[900].n_words == 0 and by[900].base_failed and by[904].n_repeat_words == 3000 and by[904].base_failed
    assert quality.score_quality(none).count() == 0 and len(got) == len(ODD) + len(texts)


@pytest.mark.parametrize("lang", [None, "it", ""])
def test_each_half_of_the_rules_decides(spark, lang):
    rng = random.Random(6)
    common = "il che non per una del con sono alla dei nel gli questa anche come più".split()
    usual = [" ".join(rng.choice(common) if rng.random() < 0.5 else prose(rng, 1) for _ in range(120)) for _ in range(40)]
    shout = " ".join(rng.choice(common).upper() if rng.random() < 0.9 else rng.choice(common) for _ in range(120))
    calls = " ".join(rng.choice(common) if rng.random() < 0.5 else str(rng.randrange(10**9, 10**12)) for _ in range(120))
    rows = [(i, t, lang) for i, t in enumerate([*usual, prose(rng, 120), calls])]
    # other languages have references of their own
    rows += [(100 + i, f"the {t}", x) for i, t in enumerate(usual[:3]) for x in (None, "it", "", "en") if x != lang] + [(200, shout, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.score_quality(df).collect()}
    assert len({r[0] for r in rows}) == len(got) and not any(r.base_failed for r in got.values())
    assert all(got[i].kept and got[i].word_distance < 0.3 for i in range(40))
    assert not got[40].kept and got[40].word_distance > 0.45 and got[40].class_distance < 0.27
    assert not got[41].kept and got[41].class_distance > 0.27 and got[41].word_distance < 0.45
    without = lambda **x: {r.doc_id for r in quality.score_quality(df, quality.Rules(**x)).collect() if r.kept}
    assert 40 in without(max_word_distance=1.0) and 41 in without(max_class_distance=1.0)
    assert got[200].class_distance == 0 and got[200].word_distance == 0


def test_repeats_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from ladderline.llm.common import words

    for r in df.select("text", quality.repeat_words(words(F.col("text"))).alias("n")).collect():
        w = WORD.findall(r.text)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r.n == len({p for i, x in enumerate(win) if win.count(x) > 1 for p in (i, i + 1, i + 2)})


def test_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5])], "p array<double>, q array<double>")
    assert df.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(0.5**0.5)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, v[3].tolist()), (601, None), (602, [0.0] * 16), (603, [None] * 16), (604, [float("nan")] * 16), (None, v[0].tolist()), (605, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 20 == 0, group_rows=100, query_rows=10).toPandas()
    full = np.vstack([v, v[3]])
    hit = 0
    for q, g in got.groupby("query_id"):
        score = full @ full[q]
        score[q] = -np.inf
        best = set(np.lexsort((np.arange(601), -score))[:20])
        hit += len(best & set(g["vec_id"]))
        assert g.sort_values("rank")["score"].is_monotonic_decreasing and q not in set(g["vec_id"])
        assert np.allclose(g["score"], score[g["vec_id"]])
    assert got["query_id"].nunique() == 31 and hit >= 0.9 * 31 * 20
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_recall_through_the_codes(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 64))
    v[2000:4000] = v[1]  # a third of all are alike
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 50 == 0, rerank=64, group_rows=700).toPandas().sort_values(["query_id", "rank"])
    recall, alike = [], [1, *range(2000, 4000)]
    for q, g in got.groupby("query_id"):
        score = v @ v[q]
        score[q] = -np.inf
        assert np.allclose(g["score"], score[g["vec_id"]]) and len(g) == 20
        order = list(zip(-g["score"].round(12), g["vec_id"]))
        assert order == sorted(order)
        if 2000 <= q < 4000:  # ties go to the smaller id
            assert g["vec_id"].tolist() == [x for x in alike if x != q][:20]
        else:
            best = np.sort(score)[-20]
            recall.append((score[g["vec_id"]] >= best - 1e-12).mean())
    assert got["query_id"].nunique() == 120 and np.mean(recall) >= 0.9


def test_ann_where_all_vectors_point_one_way(spark):
    """Unit vectors about one direction, and on a circle: nearer ones differ by less than the codes' error along it."""
    rng = np.random.default_rng(5)
    t = rng.random(3000) * 2 * np.pi
    cone = 1 + 0.05 * rng.normal(size=(3000, 64))
    for v in (cone / np.linalg.norm(cone, axis=1, keepdims=True), np.stack([np.cos(t), np.sin(t)], 1)):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = ann.search(df, F.col("id") % 50 == 0).toPandas()
        near = v[::50] @ v.T
        near[np.arange(60), np.arange(0, 3000, 50)] = -np.inf
        want = {(50 * q, x) for q in range(60) for x in np.argsort(-near[q], kind="stable")[:20]}
        assert len(got) == 1200 and len(want & set(zip(got["query_id"], got["vec_id"]))) >= 0.9 * 1200


def test_codes_choose_what_is_scored():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 16))
    index = ann.train(v, 6, 4)
    of = index.lists(v)
    codes = index.encode(v - index.centroids[of])
    probed = [np.array([0, 1, 2]), np.array([3, 5]), np.arange(6)]
    a, b, c = ann.scan(index, v[:3], np.arange(3), probed, np.arange(900), of, codes, v, k=5, rerank=12)
    books = np.split(v[:3], 4, axis=1)
    for i in range(3):
        near = [-np.inf if of[x] not in probed[i] or x == i else v[i] @ index.centroids[of[x]] + sum(books[p][i] @ index.codebooks[p][codes[x, p]] for p in range(4)) for x in range(900)]
        some = np.argsort(-np.array(near, np.float32), kind="stable")[:12]
        want = sorted(some, key=lambda x: (-(v[x] @ v[i]), x))[:5]
        assert b[a == i].tolist() == want and np.allclose(c[a == i], v[want] @ v[i])


def language(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_languages_of_held_out_texts(spark, odd):
    rng = random.Random(7)
    rows = [(i, language(rng, x, 40), y) for i, (x, y) in enumerate([("abcdefgh", "aa"), ("ghijklmn", "bb"), ("qrstäöü", "cc")] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 90"))
    got = langid.predict(df.where("doc_id >= 90").unionByName(odd.select("doc_id", "text", "lang")), model).collect()
    again = langid.fit(df.where("doc_id < 90").repartition(7))
    assert np.array_equal(model[1], again[1]) and np.array_equal(model[2], again[2])
    lang = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == lang[r.doc_id] for r in got if r.doc_id in lang)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (900, 901, 902))
    assert {r.lang_pred for r in langid.predict(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_temperature_and_ftrl():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(2000, 2)) * 2
    truth = (rng.random(2000) < 1 / (1 + np.exp(z[:, 0] - z[:, 1]))).astype(int)
    assert 2.5 < linear.temperature(3 * z, truth) < 3.6
    rows = [(np.array([k % 2]), np.ones(1)) for k in range(200)]
    w = linear.Ftrl(2, 2, 0.5, 1.0, 0.1, 0.1).fit(rows, np.eye(2)[[k % 2 for k in range(200)]], 2, 0)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_toxic_texts_are_found(spark, odd, none):
    rng = random.Random(8)
    bad = ["grumpfish", "snorkblat", "vexoria"]
    rows, labels = [], []
    for i in range(300):
        w = language(rng, "abcdefghijkl", 60).split()
        if i % 6 == 0:
            w[3], w[9] = rng.choice(bad), rng.choice(bad) + rng.choice(["", "en", "s"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df.where("doc_id < 200"), marks)
    again = toxicity.fit(df.where("doc_id < 200").repartition(7), marks)
    assert np.array_equal(model[0], again[0]) and np.allclose(model[1], again[1]) and model[2] == pytest.approx(again[2])
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 200"), model).collect()}
    assert all((s >= 0.3) == (i % 6 == 0) for i, s in got.items())
    assert all(0 <= r.score < 0.3 for r in toxicity.score(odd.select("doc_id", "text"), model).collect())
    assert toxicity.fit(df.limit(0), marks) is None and toxicity.score(df, None).agg(F.max("score")).first()[0] < 1e-9


def test_correlated_voters_count_less():
    rng = np.random.default_rng(2)
    y = (rng.random(2000) < 0.3).astype(int)
    one = (rng.random(2000) < np.where(y == 1, 0.7, 0.1)).astype(float)
    own = (rng.random(2000) < np.where(y == 1, 0.7, 0.1)).astype(float)
    label = np.where(rng.random(2000) < 0.2, y, -1)
    model, q = toxicity.fit_label_model(np.stack([one, one, one, own], 1), label)
    assert model.weight[0] < 0.5 < model.weight[3] and ((q > 0.5) == y).mean() > 0.8


def test_label_model_against_brute_force():
    """Independent voters: the posterior is Bayes' rule over both classes, votes and label taken one by one."""
    rng = np.random.default_rng(4)
    y = (rng.random(4000) < 0.4).astype(int)
    right = [(0.05, 0.8), (0.1, 0.6), (0.7, 0.1)]  # the last one votes clean
    votes = np.stack([rng.random(4000) < np.where(y == 1, b, a) for a, b in right], 1).astype(float)
    label = np.where(rng.random(4000) < 0.5, np.where(rng.random(4000) < 0.1, 1 - y, y), -1)
    model, q = toxicity.fit_label_model(votes, label)
    assert (model.weight == 1).all() and np.abs(model.rate - np.array(right).T).max() < 0.06
    assert np.abs(model.told - [0.1, 0.9]).max() < 0.05  # a tenth of the labels is wrong, and that is found
    for v, said, got in list(zip(votes, label, q))[:300]:
        both = []
        for c, p in ((0, 1 - model.prior), (1, model.prior)):
            for j in range(3):
                p *= model.rate[c, j] if v[j] else 1 - model.rate[c, j]
            both.append(p * {1: model.told[c], 0: 1 - model.told[c], -1: 1.0}[said])
        assert got == pytest.approx(both[1] / sum(both), rel=1e-6)
    wrong = (label >= 0) & (label != y)
    assert ((q > 0.5) == y)[wrong].mean() > 0.15  # voters outvote some wrong labels
    silent = toxicity.fit_label_model(np.zeros((4000, 1)), label)[1]  # without them no label is doubted
    assert ((silent > 0.5) == y)[wrong].mean() == 0
    assert ((q > 0.5) == y)[label < 0].mean() > 0.85 > ((silent > 0.5) == y)[label < 0].mean()


def test_pipeline_stages_against_brute_force(spark, docs, odd, none, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    columns = docs.drop("extra").columns
    long = prose(random.Random(18), 30_000)
    more = spark.createDataFrame([(950, long, None, None, 1), (None, texts[30][1], None, None, 1), (30, texts[31][1] * 3, "", "", 1)], docs.drop("extra").schema)
    d = docs.unionByName(odd).drop("extra").unionByName(more).repartition(5)
    stage = dict(corpus_pipeline.STAGES)

    def rows(df):
        assert df.columns == columns
        return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))

    good = stage["quality_rules"](spark, d, "").checkpoint()
    rules = {(r.doc_id, r.n_words): r.kept for r in quality.score_quality(d).collect()}
    assert [(r.doc_id, r.text) for r in rows(good)] == [(r.doc_id, r.text) for r in rows(d) if rules[r.doc_id, len(WORD.findall(r.text or ""))]]
    assert 950 in {r.doc_id for r in rows(good)}
    alone = stage["near_dedup"](spark, good, "").checkpoint()
    left = rows(good)
    sets = [shingles(r.text) for r in left]
    group = list(range(len(left)))
    for _ in left:
        for x in range(len(left)):
            for y in range(x):
                if abs(len(sets[x]) - len(sets[y])) <= 0.2 * max(len(sets[x]), len(sets[y])) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    group[x] = group[y] = min(group[x], group[y])
        if all(group[g] == g for g in group):
            break
    assert len(rows(alone)) == len(set(group))
    cut = stage["substring_dedup"](spark, alone, "").checkpoint()
    seen, before = {}, {(r.doc_id, r.text) for r in rows(alone)}
    for n, r in enumerate(rows(cut)):
        w = tuple(WORD.findall(r.text))
        assert not any(seen.setdefault(w[p : p + 55], n) != n for p in range(len(w) - 54))
        if r.doc_id is not None and r.doc_id < 60:  # texts of their own
            assert (r.doc_id, r.text) in before
    mixed = stage["mixing"](spark, cut, "").checkpoint()
    size, taken = {}, {}
    for x, df in ((size, cut), (taken, mixed)):
        for r in rows(df):
            x[r.source] = x.get(r.source, 0) + len(WORD.findall(r.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.capped_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], sum(size.values()), 3)):
        assert abs(taken.get(s, 0) - t) <= 0.02 * t + 1
    packed = stage["packing"](spark, mixed, "").collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(own.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows(mixed))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none.drop("extra"), "").count() == 0, name


@pytest.mark.parametrize("name", ["op5_chat_format", "op7_near_dedup", "op10_quality_rules"])
def test_agrees_with_sql(spark, name):
    import os

    import duckdb

    from ladderline.llm.queries import ORACLES, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    got = [[r[c] for c in columns] for r in QUERIES[name](spark, data).collect()]
    plain = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(got) == plain(found.fetchall())
