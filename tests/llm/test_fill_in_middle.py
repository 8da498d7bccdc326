"""Fill-in-middle against a plain version, whole and dealt out as chunks; the automata by themselves."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import fill_in_middle as fim
from ladderline.llm.automaton import marked, string_automaton, summary, unit_automaton

DOCS = "doc_id long, text string, row long, n long, form string"  # with names that the result has too


def plain(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    p, m = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b, c = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    odd = [None, "", "\n", "\n\n\n", "a", "a\nb", "<", "<P", "<P<", "x<S>y\n", "a\n<M>", "<\nP>", "é\nß\n" * 40, "<<P>", "line\r\nline\n", "\n" * 300, "x" * 3000]
    some = ["".join(rng.choice("ab<PSM>é\n \n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(odd + some)]
    return rows + [(None, "no\nid\nhere"), (7, "shared\nid"), (7, "shared\nid"), (7, "shared, another text\n" * 30)]


@pytest.mark.parametrize(("chunk", "rate"), [(1 << 20, 100), (1, 100), (50, 60)])
def test_equals_the_plain_version(spark, rows, chunk, rate):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS)
    made = fim.fill_in_middle(docs, chunk_bytes=chunk, rate=rate).withColumn("output", F.col("output").cast("string")).collect()
    got, dealt = [], {}
    for r in made:
        if r.row is None:
            got.append((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output))
        else:
            dealt.setdefault(r.row, []).append(r)
    assert bool(dealt) == (chunk < 1 << 20)
    pieces = fim.fill_in_middle(docs, chunk_bytes=chunk, rate=rate).where("row is not null")
    for group in dealt.values():
        group.sort(key=lambda r: r.piece)
        assert len({r.piece for r in group}) == len(group)
    # pieces may end inside a character: put together as bytes
    for g in pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", "output", "doc_id", "n", "form", "prefix_chars", "middle_chars"))).alias("all")).collect():
        one = g["all"][0]
        got.append((one.doc_id, one.n, one.form, one.prefix_chars, one.middle_chars, b"".join(bytes(p.output) for p in g["all"]).decode()))
    assert sorted(got, key=repr) == sorted((plain(i, t, rate) for i, t in rows), key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 20])
def test_output_restores_every_text(spark, rows, chunk):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(docs, chunk_bytes=chunk).where("doc_id is not null").collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((i, sha(plain(i, t)[5]), sha(t or "")) for i, t in rows if i is not None)


def test_no_documents(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []


def test_summaries_compose():
    rng = np.random.default_rng(1)
    a = fim.scanner("lines")
    text = rng.choice(np.frombuffer(b"<PSM>\nab", np.uint8), 5000)
    whole_end, whole_count = summary(a, text)
    state, counts = np.arange(len(a.step)), np.zeros_like(whole_count)
    for part in np.array_split(text, 7):
        end, count = summary(a, part)
        counts, state = counts + count[:, state], end[state]
    assert (state == whole_end).all() and (counts == whole_count).all()


def test_units_and_strings():
    text = np.frombuffer(b" one  two\nthree<P<P>aaa", np.uint8)
    assert marked(unit_automaton("words"), text)[0].tolist() == [1, 6, 10]
    assert marked(unit_automaton("lines"), text)[0].tolist() == [0, 10]
    assert marked(string_automaton([b"<P>", b"aa"]), text)[0].tolist() == [19, 21, 22]
    with pytest.raises(ValueError, match="no such units"):
        unit_automaton("verses")
