import json
import os
import subprocess
import time

import pytest

from quarryline.functions import paths
from quarryline.sources import ignore as IG
from quarryline.sources import scan as SC
from quarryline.sources import store as ST
from quarryline.sources import tables as TB


def put(root, files):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_gates(spark, tmp_path):
    put(tmp_path, {"a.py": "x = 1\n", "b/c.md": "# t\n", ".env.local": "K=1", "id_rsa": "k", "s/cert.pem": "k", "bin.dat": b"a\x00b", "blank.txt": "  \n", "empty.txt": "", "bad.txt": b"\xff\xfe", ".git/config": "x", "node_modules/m.js": "x", "big.txt": "x" * (SC.MOST_TEXT_BYTES + 1)})
    got = {r["path"] for r in SC.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py", "b/c.md"}
    with pytest.raises(ValueError):
        SC.scan(spark, str(tmp_path / "a.py"))


def test_stat_cache_spares_reading(spark, tmp_path):
    put(tmp_path, {"a.py": "x", "b.py": "y"})
    for n in ("a.py", "b.py"):
        os.utime(tmp_path / n, (1_000_000, 1_000_000))
    first = spark.createDataFrame(SC.scan(spark, str(tmp_path)).select("path", "size", "mtime", "blob").collect())
    put(tmp_path, {"b.py": "zz"})
    again = {r["path"]: r for r in SC.scan(spark, str(tmp_path), first, time.time()).collect()}
    old = {r["path"]: r["blob"] for r in first.collect()}
    assert again["a.py"]["gate"] == "cached" and again["a.py"]["blob"] == old["a.py"]
    assert again["b.py"]["gate"] == "ok" and again["b.py"]["blob"] != old["b.py"]


PATHS = ["a.log", "keep.log", "build/x.o", "src/build/y.o", "src/a.tmp", "docs/x.md", "docs/keep.md", "docs/sub/z.md", "logs/l.txt", "deep/a/b/c.txt", "deep/c.txt", "foo/bar", "x/foo/bar", "q?", "w1", "w2/w1", "abc/def.txt", "t/cache/k", "cache", "sp ace.txt"]
RULES = "*.log\n!keep.log\n/out/\n**/tmp\nsrc/*.tmp\ndocs/*.md\n!docs/keep.md\nlogs/\ndeep/**/c.txt\nfoo/bar\n/w1\n# note\n[a]bc/\ncache/\n"


def test_rules_agree_with_git(tmp_path):
    put(tmp_path, {p: "x" for p in PATHS})
    (tmp_path / ".gitignore").write_text(RULES)
    try:
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, capture_output=True)
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", *PATHS], capture_output=True, text=True).stdout.split("\n")
    rules = IG.parse_rules(RULES)
    ours = {p for p in PATHS if IG.ignored(rules, p, False) or any(IG.ignored(rules, "/".join(p.split("/")[:i]), True) for i in range(1, p.count("/") + 1))}
    assert ours == {s for s in said if s}


def test_include_layer_brings_back(tmp_path):
    put(tmp_path, {".gitignore": "gen/\n", ".includeignore": "!gen/keep.py\n", "gen/keep.py": "x", "gen/other.py": "y", "a.py": "z"})
    got = {f[0] for f in SC.list_files(str(tmp_path)).files}
    assert "gen/keep.py" in got and "a.py" in got


@pytest.mark.parametrize("pattern,value,ok", [("docs/**", "docs", False), ("docs/**", "docs/a/b", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/b", "b", True), ("*.py", "a.py", True), ("*.py", "a/b.py", False), ("[ab].c", "b.c", True), ("a?c", "abc", True)])
def test_globs(pattern, value, ok):
    assert IG.glob_match(pattern, value) is ok


def test_readers_fail_on_malformed_rows(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "text": "a", "group": "g"}\n{"id": "2", "text": "b"}\n')
    assert [tuple(r) for r in TB.read_queries(spark, str(tmp_path / "q.jsonl")).orderBy("qid").collect()] == [("1", "a", "g"), ("2", "b", None)]
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n')
    with pytest.raises(Exception):
        TB.read_queries(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "qrels.tsv").write_text("1\td1\t2\n1\td2\tx\n")
    with pytest.raises(Exception):
        TB.read_qrels(spark, str(tmp_path / "qrels.tsv")).collect()


def test_vector_sink_refuses_bad_rows(spark, tmp_path):
    good = spark.createDataFrame([("k", [3.0, 4.0])], "embed_key string, v array<float>")
    TB.write_vectors(good, str(tmp_path / "v"), 2)
    assert TB.read_vectors(spark, str(tmp_path / "v"), 2).first()["v"] == pytest.approx([0.6, 0.8])
    for bad in ([0.0, 0.0], [1.0], [float("nan"), 1.0]):
        with pytest.raises(Exception):
            TB.write_vectors(spark.createDataFrame([("k", bad)], "embed_key string, v array<float>"), str(tmp_path / "w"), 2)


def segment(store, name="x"):
    sid, stage = store.stage()
    os.makedirs(stage)
    with open(os.path.join(stage, "data"), "w") as f:
        f.write(name)
    return store.add_segment(sid)


def test_publish_verify_fall_back_and_collect(tmp_path):
    s = ST.Store(str(tmp_path))
    revs, prev = [], None
    for i in range(3):
        seg = segment(s, str(i))
        m = s.publish(ST.Manifest(f"r{i}", prev, files={"a": ST.FileEntry("h", 1, seg.id)}, segments=[seg]))
        revs.append(m)
        prev = m.revision
    assert s.usable().revision == "r2"
    with open(s.path("segments", revs[2].segments[0].id, "data"), "a") as f:
        f.write("torn")
    assert s.usable().revision == "r1"
    gone = s.collect()
    assert gone == [revs[0].segments[0].id] and s.load("r1").revision == "r1"
    with pytest.raises(ValueError):
        s.publish(ST.Manifest("bad", files={"a": ST.FileEntry("h", 1, "nowhere")}))


def test_manifest_versions():
    v1 = json.dumps({"revision": "r", "files": {"a": {"content_hash": "h", "chunk_count": 3}}, "vector_count": 2})
    m = ST.Manifest.from_json(v1)
    assert m.schema_version == 2 and m.segments[0].chunks == 3 and not m.problems()
    assert ST.Manifest.from_json(m.to_json()) == m
    with pytest.raises(ValueError):
        ST.Manifest.from_json('{"schema_version": 9, "revision": "r"}')


def test_lock(tmp_path):
    a, b = ST.Lock(str(tmp_path / "L")), ST.Lock(str(tmp_path / "L"))
    assert a.acquire() and not b.acquire() and a.held()
    os.utime(tmp_path / "L", (1, 1))
    assert b.acquire() and not a.held()
    b.release()
    assert not (tmp_path / "L").exists()


def test_journal(spark, tmp_path):
    j = ST.Journal(spark, str(tmp_path), 2)
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "embed_key string, v array<float>")
    j.append(rows)
    j.append(rows)
    assert j.entries().count() == 2
    j.compact(rows.filter("embed_key = 'a'"))
    assert [r["embed_key"] for r in j.entries().collect()] == ["b"]
    with pytest.raises(Exception):
        j.append(spark.createDataFrame([("c", [1.0])], "embed_key string, v array<float>"))
    j.reject(rows.filter("embed_key = 'b'"))
    assert j.rejected().count() == 1


def test_paths():
    assert paths.resolve_root(r"C:\a\.\b", "linux") == ("/mnt/c/a/b", "wsl")
    assert paths.resolve_root("/mnt/d/x/..", "windows") == ("D:\\", "windows")
    assert paths.resolve_root("/a//b/") == ("/a/b", "posix")
    for bad in ("C:x", "rel", ""):
        with pytest.raises(ValueError):
            paths.resolve_root(bad)
    assert paths.expand_user("~/x/$N/%M%/${Z}", {"HOME": "/h", "N": "n", "M": "m"}) == "/h/x/n/m/${Z}"


def test_content_gate():
    assert [SC.gate(x) for x in (b"", b" \n", b"a\x00", b"\xff", b"ok")] == ["empty", "blank", "binary", "binary", "ok"]
