import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.operators import splitters as SP


def symbols(path, text):
    return [c.symbol for c in SP.split_file(path, text) if c.symbol]


def test_line_windows():
    text = "\n".join(f"line {i}" for i in range(150))
    got = SP.windows(text, "go")
    assert [c.start for c in got] == [1, 51, 101] and got[-1].end == 150
    md = SP.windows("\n".join("x" * 10 for _ in range(100)), "markdown")
    assert all(c.end - c.start + 1 <= 40 for c in md)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aä€\U0001f600 ", max_size=3000), max_size=6))
def test_byte_limit_and_nothing_lost(lines):
    text = "\n".join(lines)
    got = SP.windows(text, "go", window=10**6)
    assert all(len(c.content.encode()) <= SP.MOST_BYTES for c in got)
    kept = "".join(c.content for c in got)
    assert sorted("".join(kept.split())) == sorted("".join(text.split()))


def test_overlap_as_wide_as_the_window():
    got = SP.windows("\n".join(map(str, range(20))), "go", window=4, overlap=9)
    assert [c.start for c in got][:3] == [1, 3, 5]


PY = '''import os

LIMIT = 3

# says hello
@cache
def hello(x):
    return x

class Big:
    """doc"""
    a = 1
''' + "".join(f"\n    def m{i}(self):\n" + "        x = 1\n" * 30 for i in range(10))


def test_python():
    got = SP.split_file("a.py", PY)
    assert {c.capability for c in got} == {"ast"}
    s = [c.symbol for c in got]
    assert "hello" in s and "Big" in s and "Big.m3" in s
    hello = next(c for c in got if c.symbol == "hello")
    assert hello.content.startswith("# says hello")
    assert SP.split_file("a.py", "def broken(:\n")[0].capability == "fallback"


GO = """package main

import "fmt"

// T is a thing.
type T struct {
	a string // }
}

func (t *T) Name() string {
	return "{" + t.a
}

func main() {
	fmt.Println("}")
}
"""
CASES = {
    "a.go": (GO, ["T", "T.Name", "main"]),
    "a.java": ("package p;\n\npublic class A {\n  int x;\n  public int get() { return x; }\n}\n\ninterface B { void f(); }\n", ["A", "B"]),
    "a.rs": ("use std::fmt;\n\n/// Doc\npub struct S { a: u8 }\n\nimpl fmt::Display for S {\n    fn fmt(&self) { let c = '}'; }\n}\n\nfn main() { println!(\"{}\", 1); }\n", ["S", "fmt::Display for S", "main"]),
    "a.c": ('#include <x.h>\n\nstatic int add(int a, int b)\n{\n    return a + b; /* } */\n}\n\nint main(void) { return add(1, 2); }\n', ["add", "main"]),
    "a.cpp": ("namespace n {\nclass K {\n public:\n  int f() { return 1; }\n};\nint K::g(int x) { return x; }\n}\n", ["K", "K::g"]),
    "a.cs": ("using System;\nnamespace N {\n  public class C {\n    public int F(int a) { return a; }\n  }\n}\n", ["C"]),
    "a.kt": ("package k\n\nclass A {\n    fun f(): Int = 1\n}\n\nfun top(x: Int): Int {\n    return x\n}\n", ["A", "top"]),
    "a.js": ("import x from 'y'\n\nexport function f(a) {\n  return `}${a}`\n}\n\nconst g = (x) => {\n  return x\n}\n\nclass C {\n  m() { return 1 }\n}\n", ["f", "g", "C"]),
    "a.ts": ("export interface I { a: number }\n\nexport const h = async (x: number): Promise<number> => {\n  return x;\n};\n", ["I", "h"]),
    "a.php": ("<?php\n\nfunction f($a) {\n  return $a; // }\n}\n\nclass P {\n  public function q() { return 1; }\n}\n", ["f", "P"]),
    "a.rb": ("require 'x'\n\n# A doc\nmodule M\n  class K\n    def self.a\n      1\n    end\n  end\nend\n\ndef top\n  2\nend\n", ["M", "top"]),
}


@pytest.mark.parametrize("path", CASES)
def test_declarations(path):
    text, want = CASES[path]
    got = SP.split_file(path, text)
    assert {c.capability for c in got} == {"ast"}
    for name in want:
        assert name in [c.symbol for c in got], (name, [c.symbol for c in got])
    lines = [x for x in text.split("\n") if x.strip()]
    covered = "\n".join(c.content for c in got)
    assert all(x in covered for x in lines)


def test_members_of_a_large_class():
    body = "".join(f"  public int m{i}(int a) {{\n" + "    a += 1;\n" * 40 + "    return a;\n  }\n" for i in range(8))
    s = symbols("A.java", "class A {\n" + body + "}\n")
    assert s[0] == "A" and "A.m3" in s


def test_unbalanced_file_falls_back():
    assert SP.split_file("a.go", "func main() {\n")[0].capability == "fallback"
    assert SP.split_file("a.txt", "words")[0].capability == "fallback"
    assert SP.split_file("a.go", "  \n") == []


def test_merge_of_small_declarations():
    lines = ["a", "b", "c" * 600, "d"]
    got = SP.merge_small([SP.Span(1, 1, "x"), SP.Span(2, 2, "y"), SP.Span(3, 3, "z"), SP.Span(4, 4, "f", True)], lines)
    assert [(s.start, s.end, s.symbol) for s in got] == [(1, 2, "x"), (3, 3, "z"), (4, 4, "f")]


def test_split_table_is_deterministic(spark):
    rows = [(p, c[0]) for p, c in CASES.items()] + [("n.go", None), (None, "x"), ("e.go", "")]
    d = spark.createDataFrame(rows, "path string, content string")
    one = [r.asDict() for r in SP.split(d).orderBy("path", "start").collect()]
    two = [r.asDict() for r in SP.split(d.repartition(3)).orderBy("path", "start").collect()]
    assert one == two and {r["path"] for r in one} == set(CASES)
    assert len({r["id"] for r in one}) == len(one)
