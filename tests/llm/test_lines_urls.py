import re

import pytest

from quarryline.llm import lines as L
from quarryline.llm import urls as U


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else set()
    cover = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_measures_of_odd_rows(docs_of, odd):
    rows = [r for r in odd if r[0] != 5] + [(11, "a b c d e f\na b c d e g\n a b c d e f\na b c d e f"), (12, "x y z x y z x y z x y z"), (13, "#$ <b> & | %")]
    got = L.measure(docs_of(rows)).collect()
    assert sorted(tuple(r[1:6]) for r in got) == sorted(brute(t) for _, t in rows)
    assert all(r["base_failed"] for r in got if r["n_words"] < 10)
    assert L.measure(docs_of([])).count() == 0


GOOD = "This is a sentence of plain words that ends well. Here is another one for you.\n"


@pytest.mark.parametrize("line,rule", [("Home | About | Blog | Contact", "navigation"), ("All rights reserved by someone.", "boilerplate"), ("w*** x&&& y%%% z###", "noise"), ("BUY!! NOW!! OR!! NEVER!!", "noise"), ("A short heading", "punctuation"), ("It ends well.", None), ("Quoted “like this.”", None), ("Is it? Yes!", None), (" ".join(["word"] * 30), None)])
def test_line_rules(line, rule):
    assert L.failing_rule(line, len(line.split())) == rule


def test_verdicts_and_cleaning(docs_of, prose):
    body = "\n".join(prose(15, i) + "." for i in range(6))
    rows = [(1, body), (2, "Home | About | Blog | News\n" * 1 + "\n".join(f"a{i} | b{i} | c{i}" for i in range(9))), (3, body + "\nAll rights reserved."), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in L.measure(docs_of(rows), with_text=True).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4, 5)] == [True, False, True, False, False]
    assert got[3]["cleaned"] == body and got[3]["failed_lines"] == 1
    kept = L.clean(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {1: (body, len(body)), 3: (body, len(body))}
    assert L.clean(docs_of([])).count() == 0


def test_lines_query_equals_sql(spark, sf, duck, same):
    same(L.query(spark, sf), duck.sql(L.ORACLE))


# --- URLs ------------------------------------------------------------------------------------

PAGES = [(1, "http://A.Example.ORG/es/x?y#z", "org/"), (2, "https://x.org", None), (3, None, None), (4, "mailto:a@b.org/", None), (5, "http://example.org/en/12/q", None), (6, "http://example.org/en/2", None), (7, "http://notexample.org/es/", None), (8, "ftp://com/de/", None), (9, "http://u:p@h.com:80/fr/", None), (10, "http://h.com/fr/casino/x", None), (11, "http://cheap-pills.net/a", None), (12, "http://h.net?x=/es/", None), (13, "http://h.net/a#b?c", None), (14, "http://evil.com/DE/", None), (15, "http://a.b/://c.org/", None), (1, "http://casino.net/", None)]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if rest else ""
    best = None
    for action, where in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")):
        h, _, p = where.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(where) > len(best[1])):
            best = action, where
    return host, path, best[1] if best else None, best[0] if best else None


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_rules(spark, limit):
    d = spark.createDataFrame([(i, u, "r") for i, u, _ in PAGES], "page_id long, url string, rule string")
    got = sorted(map(tuple, U.classify(d, [*U.CONTRACT_RULES, *U.PATTERN_RULES], broadcast_rules=limit).collect()), key=str)
    want = []
    for i, u, _ in PAGES:
        host, path, rule, action = expected(u)
        word = next((w for w in ("casino", "cheap-pills") if rule is None and w in host + path), None)
        want.append((i, host, path, rule or (f"word:{word}" if word else None), action or ("block" if word else "allow")))
    assert got == sorted(want, key=str)


def test_only_fetched_rules_run(spark):
    d = spark.createDataFrame([(i, f"http://s{i}.net/common/rare{i % 2}") for i in range(9)], "page_id long, url string")
    rules = [U.Rule("a", "block", "common/rare1", ("common", "rare1")), U.Rule("b", "block", "never", ("unseen",)), U.Rule("c", "flag", "s3", (), 5)]
    place = d.selectExpr("url AS place")
    assert U.rarest_tokens(place, rules) == {"a": "rare1", "b": "unseen", "c": None}
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.classify(d, rules).collect()}
    assert got[1] == ("a", "block") and got[3] == ("c", "flag") and got[2] == (None, "allow")


def test_both_paths_agree_on_thousands_of_rules(spark, sf):
    """Rules from the pages' own tokens, many of equal rank, some without a literal, in any letters."""
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    tokens = sorted({t for u in urls for t in re.findall("[a-z0-9]+", u.lower())})
    rules = [U.word_rule(t) for t in tokens] + [U.Rule(f"pair-{a}-{b}", "flag", f"{a}.*{b}", (a, b), i % 3) for i, (a, b) in enumerate(zip(tokens, tokens[7:]))]
    rules += [U.Rule("long", "flag", "[0-9]{4}", (), 1), U.Rule("also-long", "block", "[0-9]{4}", (), 1), U.Rule("kelvin", "block", "k", ("k",), 9)]
    rules += [U.word_rule(f"{t} {i}") for t in tokens for i in range(2000 // len(tokens) + 1)]
    assert len(rules) > 2000
    more = [(-1, "http://a.net/casino/porn"), (-2, "http://a.net/\u212a"), (-3, None), (-4, None), (-5, "http://\u0130.net/CASINO")]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + more, "page_id long, url string")
    rules += [U.word_rule("casino"), U.word_rule("porn")]
    a, b = (sorted(map(tuple, U.classify(d, rules, broadcast_rules=n).collect()), key=str) for n in (U.BROADCAST_RULES, 0))
    assert a == b and {r[3] for r in a if r[0] in (-1, -5)} == {"word:casino"} and {r[3] for r in a if r[0] == -2} == {"word:net"}
    assert len({r[3] for r in a}) > 20


def test_no_rules_and_no_pages(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    assert U.classify(d, list(U.CONTRACT_RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert U.classify(one, []).first()["verdict"] == "allow"


def test_urls_query_equals_sql(spark, sf, duck, same):
    same(U.query(spark, sf), duck.sql(U.ORACLE))
