import random

from quarryline.operators import blocks as BL


def test_merge_never_bridges_gaps_and_keeps_each_line_once(spark):
    rows = [("q", "a", 1, 3, "", 0.2, "l1\nl2\nl3"), ("q", "a", 3, 5, "f", 0.9, "l3\nl4\nl5"), ("q", "a", 6, 6, "g", 0.1, "l6"), ("q", "a", 8, 9, "", 0.5, "l8\nl9"), ("q", "b", 2, 9, "", 0.3, "\n".join(f"m{i}" for i in range(2, 10))), ("q", "b", 4, 5, "h", 0.4, "m4\nm5")]
    d = spark.createDataFrame(rows, "qid string, path string, start int, end int, symbol string, score double, content string")
    got = [tuple(r) for r in BL.merge_blocks(d).orderBy("path", "start").select("path", "start", "end", "symbol", "score", "content").collect()]
    assert got == [("a", 1, 6, "f", 0.9, "l1\nl2\nl3\nl4\nl5\nl6"), ("a", 8, 9, "", 0.5, "l8\nl9"), ("b", 2, 9, "h", 0.4, "\n".join(f"m{i}" for i in range(2, 10)))]


def fold(blocks, budget):
    left, seen, taken = budget, set(), set()
    for first in (True, False):
        for rank, path, size in blocks:
            if rank in taken or (path not in seen) != first or size > left:
                continue
            left -= size
            seen.add(path)
            taken.add(rank)
    return taken


def test_selection_equals_the_fold(spark):
    r = random.Random(2)
    rows = [(q, "abcde"[r.randrange(5)], i + 1, r.randint(1, 60)) for q in range(30) for i in range(r.randint(1, 12))]
    rows = [(q, p, i, s) for q, p, i, s in rows]
    d = spark.createDataFrame(rows, "qid int, path string, rank int, bytes long")
    got = {}
    for x in BL.select_within(d, 100).collect():
        if x["shown"]:
            got.setdefault(x["qid"], set()).add(x["rank"])
    want = {q: fold([(i, p, s) for qq, p, i, s in sorted(rows, key=lambda x: x[2]) if qq == q], 100) for q in range(30)}
    assert got == {q: t for q, t in want.items() if t}


def test_omitted_and_stats(spark):
    rows = [("q", "a", 1, 2, 1, True), ("q", "b", 1, 2, 2, False), ("q", "b", 5, 6, 3, False), ("q", "c", 1, 1, 4, False), ("q", "a", 9, 9, 5, False)]
    d = spark.createDataFrame(rows, "qid string, path string, start int, end int, rank int, shown boolean")
    assert [tuple(r) for r in BL.omitted_files(d).orderBy("place").collect()] == [("q", "b", 1, 2, 1), ("q", "c", 1, 1, 2)]
    s = BL.display_stats(d).first()
    assert (s["candidate_blocks"], s["shown_blocks"], s["shown_files"], s["truncated"]) == (5, 1, 1, True)


def test_map_takes_every_directory_first(spark):
    rows = [(f"core/f{i}.py", 9, f"s{i}{j}") for i in range(4) for j in range(4 - i)] + [("web/v.js", 3, "render"), ("README.md", 2, "")]
    d = spark.createDataFrame(rows, "path string, end int, symbol string")
    files = BL.map_files(d)
    got = BL.select_map(files, 10_000).orderBy("used").collect()
    assert [r["path"] for r in got] == ["core/f0.py", "web/v.js", "README.md", "core/f1.py", "core/f2.py", "core/f3.py"]
    assert got[-1]["used"] == sum(r["cost"] for r in got)
    few = BL.select_map(files, got[2]["used"]).collect()
    assert len(few) == 3
    assert BL.map_files(d, "core").count() == 4
