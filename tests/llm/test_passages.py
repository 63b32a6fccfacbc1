import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import common as C
from quarryline.llm import passages as P


def brute_windows(v, width):
    """By the Cartesian tree itself."""
    out, todo = [], [(0, len(v) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 < width:
            continue
        c = min(range(lo, hi + 1), key=lambda i: (v[i], i))
        out.append((lo, c, hi))
        todo += [(lo, c - 1), (c + 1, hi)]
    return sorted(out, key=lambda x: x[1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 9), st.integers(1, 20))
def test_compact_windows_equal_the_tree(values, width, split):
    v = np.array(values, np.uint64) << np.uint64(40)
    assert list(zip(*(x.tolist() for x in P.compact_windows(v, width)))) == brute_windows(values, width)
    owner = np.arange(len(values)) // split
    want = []
    for o in range(owner.max() + 1 if len(values) else 0):
        at = np.flatnonzero(owner == o)
        want += [tuple(int(at[0]) + x for x in w) for w in brute_windows([values[i] for i in at], width)]
    assert list(zip(*(x.tolist() for x in P.compact_windows(v, width, owner)))) == want


def shared(docs, n):
    seen = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s}


def planted(prose, n=60):
    docs = []
    passages = [prose(58, 1000 + i) for i in range(4)]
    for i in range(n):
        t = prose(150, i).split()
        if i % 3 == 0:
            at = (i * 7) % 100
            t[at:at] = passages[i % 4].split()
        docs.append((i, " ".join(t)))
    return docs


def test_exact_passages_against_brute_force(docs_of, prose):
    docs = planted(prose)
    got = P.repeated_passages(docs_of(docs)).collect()
    flagged = {r["doc_id"] for r in got}
    assert shared(docs, 54) <= flagged <= shared(docs, 40)
    for r in got:
        assert r["exact"] and 44 <= r["end_word"] - r["start_word"] <= 64 and r["first_doc_id"] <= r["doc_id"]
    firsts = {r["first_doc_id"] for r in got if r["first_doc_id"] == r["doc_id"]}
    assert len(firsts) == 4


def test_near_duplicates_are_found(docs_of, prose):
    r = random.Random(5)
    base = prose(300, 77).split()
    edited = [w if r.random() > 0.03 else "changed" + str(i) for i, w in enumerate(base)]
    got = P.repeated_passages(docs_of([(1, " ".join(base)), (2, " ".join(edited)), (3, prose(300, 78))])).collect()
    assert 2 in {x["doc_id"] for x in got} and 3 not in {x["doc_id"] for x in got}


def test_hot_passage_in_many_documents(docs_of, prose, monkeypatch):
    hot = prose(70, 5)
    docs = [(i, prose(60, 100 + i) + " " + hot + " " + prose(40, 900 + i)) for i in range(200)]
    got = {r["doc_id"]: r for r in P.repeated_passages(docs_of(docs).coalesce(1)).collect()}
    assert set(got) == set(range(200))
    assert [i for i in got if got[i]["first_doc_id"] == i] == [0]


def test_odd_rows(docs_of, odd):
    got = P.repeated_passages(docs_of([*odd, (50, "same word " * 400), (51, "same word " * 300)])).collect()
    assert {r["doc_id"] for r in got} == {7, 8, 50, 51}
    assert P.repeated_passages(docs_of([])).count() == 0


def test_cut_spans():
    t = "a  b\nc d e\tf"
    assert P.cut_spans(t, [(1, 3)]) == "a d e\tf"
    assert P.cut_spans(t, [(0, 2), (4, 9)]) == "\nc d"
    assert P.cut_spans(t, []) == t


def test_one_copy_of_each_passage_stays(docs_of, prose):
    docs = planted(prose)
    out = P.without_repeats(docs_of([*docs, (90, None), (91, ""), (None, prose(80, 5000))]))
    assert out.columns == docs_of([]).columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {*range(60), 90, 91, None}
    assert shared([(i, r["text"]) for i, r in got.items() if r["text"]], 50) == set()
    clean = set(range(60)) - shared(docs, 50)
    assert all(got[i]["text"] == dict(docs)[i] for i in clean)
    assert all(r["n_chars"] == len(r["text"] or "") for i, r in got.items() if i in range(60))
    copies = P.without_repeats(docs_of([(1, prose(80, 1)), (2, prose(80, 1))])).collect()
    assert [r["doc_id"] for r in copies] == [1]


def test_near_duplicates_are_compared_word_by_word(docs_of, prose, monkeypatch):
    """Twelve shared words in every 30 speak for a run by their pivots; most words are others."""
    r = [prose(12, 600 + i) for i in range(12)]
    docs = [(k, " ".join(x + " " + prose(18, 100 * k + i) for i, x in enumerate(r))) for k in (1, 2)]
    a, b = (np.array([hash(w) for w in t.split()], np.int64).view(np.uint64) for _, t in docs)
    assert 0.35 < P.agreement(a, b) < 0.45 and P.agreement(a, a) == 1 and P.agreement(a[:3], b) == 0
    base = prose(300, 77).split()
    edited = [w if i % 25 else "changed" + str(i) for i, w in enumerate(base)]
    docs += [(3, " ".join(base)), (4, " ".join(edited))]
    got = {(x["doc_id"], x["first_doc_id"]) for x in P.repeated_passages(docs_of(docs)).collect()}
    assert got == {(3, 3), (4, 3)}


def test_links_among_the_later_documents_of_a_group(docs_of, prose):
    """Document 1 has pieces too short for a passage and is the first of their pivots' groups."""
    base = prose(120, 50).split()
    pieces = " ".join(prose(50, 60 + i) + " " + " ".join(base[a : a + 20]) for i, a in enumerate((0, 25, 50, 75, 100)))
    edited = [w if i % 17 else f"edit{i}" for i, w in enumerate(base)]
    docs = [(1, pieces), (2, prose(90, 71) + " " + " ".join(base)), (3, prose(40, 72) + " " + " ".join(edited) + " " + prose(60, 73))]
    got = {(x["doc_id"], x["first_doc_id"]) for x in P.repeated_passages(docs_of(docs)).collect()}
    assert got == {(2, 2), (3, 2)}


def test_near_duplicates_of_one_word_in_twenty(docs_of, prose):
    r, docs = random.Random(3), []
    for i in range(40):
        base = prose(120, 4000 + i).split()
        edited = [w if r.random() > 0.05 else f"edit{r.random()}" for w in base]
        docs += [(2 * i, prose(70, 5000 + i) + " " + " ".join(base)), (2 * i + 1, " ".join(edited) + " " + prose(70, 6000 + i))]
    got = {(x["doc_id"], x["first_doc_id"]) for x in P.repeated_passages(docs_of(docs)).collect()}
    assert all(b == a - a % 2 for a, b in got) and len({a for a, b in got if a != b}) >= 36


def test_exact_passages_from_the_least_length_on(docs_of, prose):
    docs = []
    for i, n in enumerate(n for n in range(46, 56) for _ in range(6)):
        p = prose(n, 9000 + i)
        docs += [(2 * i, prose(60, 100 + i) + " " + p + " " + prose(60, 300 + i)), (2 * i + 1, prose(75, 500 + i) + " " + p + " " + prose(50, 700 + i))]
    lengths = {i: n for i, n in enumerate(n for n in range(46, 56) for _ in range(6))}
    got = {x["doc_id"]: x["end_word"] - x["start_word"] for x in P.repeated_passages(docs_of(docs)).collect()}
    assert set(got) == {d for i, n in lengths.items() for d in (2 * i, 2 * i + 1) if n >= 50}
    assert all(got[d] == lengths[d // 2] for d in got)


def test_partners_come_in_turns_until_all_have_met():
    n = 9
    g = {"key": np.zeros(n, np.int64), "doc": np.arange(n), "pivot": np.arange(n) * 3, "fn": np.zeros(n, np.int64), "open": np.ones(n, np.int64)}
    met = []
    for turn in range(1, 6):
        x = P._next_partners(g, turn)
        met += list(zip(x["mate"].tolist(), x["doc"].tolist()))
        assert (x["shift"] == (x["doc"] - x["mate"]) * 3).all()
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    g["open"] = (g["doc"] == 4).astype(np.int64)
    met = {(a, b) for turn in range(1, 6) for a, b in zip(*(P._next_partners(g, turn)[k].tolist() for k in ("mate", "doc")))}
    assert met == {(a, b) for a in range(n) for b in range(a + 1, n) if 4 in (a, b)}


@pytest.mark.parametrize("period", [1, 2, 7, 10, 12, 16, 20, 30, 45])
def test_repeated_lines_are_covered_without_gaps(docs_of, prose, period):
    line = prose(period, 40 + period)
    times = 720 // period
    docs = [(1, prose(100, 1) + (" " + line) * times + " " + prose(70, 2)), (2, prose(63, 3) + (" " + line) * times + " " + prose(90, 4))]
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["first_doc_id"]) for r in P.repeated_passages(docs_of(docs)).collect()}
    n = period * times
    for i, at in ((1, 100), (2, 63)):
        assert at <= got[i][0] <= at + 6 and at + n - 6 <= got[i][1] <= at + n and got[i][2] == 1


def test_chain_of_overlapping_passages_loses_no_word(docs_of, prose):
    s = [prose(30, 7000 + i) for i in range(10)]
    docs = [(1, prose(60, 1) + " " + " ".join(s[:6])), (5, " ".join(s)), (9, " ".join(s[4:]) + " " + prose(60, 9))]
    got = {r["doc_id"]: r["text"].split() for r in P.without_repeats(docs_of(docs)).collect()}
    had = {w for _, t in docs for w in t.split()}
    assert {w for t in got.values() for w in t} == had
    assert got[1] == docs[0][1].split()  # the first document of the chain stays whole
    assert len(got[5]) < 130 and len(got[9]) < 75


@pytest.mark.parametrize("near", [9, 3])
def test_exact_passage_amid_words_that_agree_less(docs_of, prose, near):
    """Around 55 equal words, one word in ten differs (a near-duplicate), or only 4 words in 16 agree (none)."""
    p = prose(55, 8000)
    a, b = (prose(96, 8001 + i).split() for i in range(2))
    for k in range(96):
        if k % 10 if near == 9 else k % 16 < 4:
            b[k] = a[k]
    docs = [(1, prose(40, 1) + " " + " ".join(a[:48]) + " " + p + " " + " ".join(a[48:])), (2, prose(75, 2) + " " + " ".join(b[:48]) + " " + p + " " + " ".join(b[48:]))]
    got = {r["doc_id"]: r for r in P.repeated_passages(docs_of(docs)).collect()}
    for i, at in ((1, 88), (2, 123)):
        assert got[i]["exact"] and got[i]["start_word"] <= at and got[i]["end_word"] >= at + 55 and got[i]["first_doc_id"] == 1


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    exact = {r["doc_id"] for r in P.query(spark, sf).collect() if r["exact"]}
    assert shared(docs, 54) <= exact <= shared(docs, 40)


@pytest.mark.parametrize("n", [1, 4])
def test_gram_hash(n):
    w = C.mix(np.arange(20, dtype=np.uint64) % np.uint64(5))
    h = C.gram_hash(w, n)
    assert all((h[i] == h[j]) == (w[i : i + n] == w[j : j + n]).all() for i in range(len(h)) for j in range(len(h)))


def test_partners_of_a_hot_group_come_in_parts(monkeypatch):
    """The links of one group never lie in memory all at once, and are the same."""
    monkeypatch.setattr(P, "LINKS", 100)
    n = 300
    g = {"key": np.ones(n, np.int64), "doc": np.arange(n), "pivot": np.arange(n) % 7, "fn": np.zeros(n, np.int64), "open": np.ones(n, np.int64)}
    parts = list(P._partners_by_part(g, 2))
    assert len(parts) > 5 and max(len(x["doc"]) for x in parts) < 100 + n
    assert {(a, b) for x in parts for a, b in zip(x["mate"].tolist(), x["doc"].tolist())} == {(a, b) for a in range(1, 9) for b in range(a + 1, n)}


def test_groups_follow_the_text_not_the_settings(spark, docs_of, prose, monkeypatch):
    """A fixed number of partitions doesn't make groups larger than GROUP_TEXT; more groups give the same passages."""
    both = prose(80, 5)
    docs = docs_of([(i, f"{prose(200, 100 + i)} {both} {prose(200, 500 + i)}") for i in range(30)])
    before = {tuple(r) for r in P.repeated_passages(docs).collect()}
    assert P._groups_for(spark, 6 << 30, P.GROUP_TEXT) == (6 << 30) // P.GROUP_TEXT and len(before) == 30
    for name, to in (("GROUP_TEXT", 1000), ("TASK_TEXT", 10_000), ("GROUP_ROWS", 50), ("TASK_ROWS", 100)):
        monkeypatch.setattr(P, name, to)
    assert {tuple(r) for r in P.repeated_passages(docs).collect()} == before
