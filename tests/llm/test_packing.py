import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import packing as P
from quarryline.llm import tokencount as TC
from quarryline.llm import tokens as T


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'’ \n\t.,1é漢  \r<|>", max_size=60))
def test_ids_equal_the_tokenizers_file(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _T
    _T = globals().get("_T") or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = T.FastBpe.at(T.vocabulary(), True)
    for t in (text, text + "<|endoftext|>" + text, "word " + text, text.replace("\t", " ")):
        assert bpe.encode(t).tolist() == _T.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=120), st.sampled_from([64, 100, 2048]))
def test_bins_against_their_rules(lengths, capacity):
    p = P.Packer(capacity, 8)
    for i, n in enumerate(lengths):
        p.add(i, bytes(4 * n))
    p.finish()
    covered, bins = {}, {}
    for (i, _, at, n), number, off in p.out:
        covered.setdefault(i, []).append((at, n))
        bins.setdefault(number, []).append((off, n))
    for i, n in enumerate(lengths):
        end = 0
        for at, size in sorted(covered[i]):
            assert at == end and size > 0
            end += size
        assert end == n
    assert sorted(bins) == list(range(p.n_bins))
    for b in bins.values():
        end = 0
        for off, n in sorted(b):
            assert off == end
            end += n
        assert end <= capacity


def test_a_bin_of_class_k_takes_k_documents():
    p = P.Packer(2048)
    for i in range(300):
        p.add(i, bytes(4 * 680))  # class 3, and nothing to fill the rests with but its own kind
    assert all(n == 680 for (_, _, _, n), _, _ in p.out[:3]) and [b for _, b, _ in p.out[:3]] == [0, 0, 0]
    p = P.Packer(2048)
    for i in range(64):
        p.add(i, bytes(4 * (2048 // (1 + i % 4))))
    p.finish()
    assert all(n == len(t) // 4 for (_, t, _, n), _, _ in p.out) and len({b for _, b, _ in p.out}) <= 16 + 8 + 6 + 4


def check(rows, docs, plain):
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    seqs, covered = {}, {}
    for r in rows:
        ids = next(x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"])
        covered.setdefault((r["doc_id"], len(ids)), []).append((r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    copies = {}
    for i, xs in want.items():
        for x in xs:
            copies[i, len(x)] = copies.get((i, len(x)), 0) + 1
    for key, n in copies.items():
        at = sorted(covered[key])
        assert sum(x for _, x in at) == n * key[1]
    total = padded = 0
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 2048
        total += end
        padded += end if end & (end - 1) == 0 else 2048
    assert sorted(seqs) == list(range(len(seqs)))
    return total, padded


def test_odd_rows(docs_of, odd, plain):
    rows = P.pack(docs_of(odd)).collect()
    check(rows, odd, plain)
    assert P.pack(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        P.pack(docs_of([]), grain=0)


def test_little_padding(spark, sf, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    total, padded = check(P.query(spark, sf).collect(), docs, plain)
    assert (padded - total) / padded < 0.03


def test_most_documents_stay_whole(spark, sf):
    rows = P.pack(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).collect()
    short = {(r["doc_id"], r["doc_tokens"]) for r in rows if r["doc_tokens"] <= 2048}
    cut = {(r["doc_id"], r["doc_tokens"]) for r in rows if r["doc_tokens"] <= 2048 and r["length"] < r["doc_tokens"]}
    assert len(cut) < 0.15 * len(short)


def test_ids_are_carried(docs_of, plain):
    rows = P.pack(docs_of([(1, "hello world again")]), ids=True).collect()
    got = [x for r in sorted(rows, key=lambda r: r["start"]) for x in r["ids"]]
    assert got == [*plain.encode("hello world again", add_special_tokens=False).ids, 1]


# --- token counts ----------------------------------------------------------------------------


def test_counts_equal_brute_force(docs_of, odd):
    bpe = T.FastBpe.at(T.vocabulary(), False)
    want = sorted((i or -1, len(bpe.encode(t))) for i, t in odd)
    for block in (7, 1000, 1 << 20):
        got = TC.count_tokens(docs_of(odd), block_tokens=block).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert TC.count_tokens(docs_of([])).count() == 0


def flat(spark, tmp_path, files, **how):
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = TC.scan(TC.flat_files(spark, str(tmp_path)), str(tmp_path), 9, 2, **how).orderBy("file", "ordinal").collect()
    return [(r["file"], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in got]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_blocks_are_stitched(spark, tmp_path, block):
    got = flat(spark, tmp_path, {"a.bin": [1, 2, 9, 9, 3, 4, 5, 9], "b.bin": [], "c.bin": [7, 7, 7], "d.bin": [9, 1]}, block_tokens=block)
    assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 3, True), ("c.bin", 0, 0, 3, False), ("d.bin", 0, 0, 0, True), ("d.bin", 1, 1, 1, False)]


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x01\x00\x02")
    with pytest.raises(Exception, match="whole ids"):
        TC.scan(TC.flat_files(spark, str(tmp_path)), str(tmp_path), 9).collect()


def test_ids_of_a_large_vocabulary_take_four_bytes(docs_of, tmp_path):
    """The same vocabulary with its last tokens renumbered beyond 65,535, one of them by 65,536 more than the end id."""
    lines = open(T.vocabulary(), "rb").read().splitlines()
    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"\n".join(x.split()[0] + b" %d" % (int(x.split()[1]) if int(x.split()[1]) < 300 else int(x.split()[1]) - 300 + T.EOD + 65_536 - 5) for x in lines))
    assert TC.width_of(T.vocabulary()) == 2 and TC.width_of(str(path)) == 4
    docs = [(i, f"the {w} of a long sentence about nothing") for i, w in enumerate(["river", "house", "engine", ""])]
    want = {r["doc_id"]: r["n_tokens"] for r in TC.count_tokens(docs_of(docs)).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in TC.count_tokens(docs_of(docs), vocab=str(path)).collect()} == want


def test_count_query(spark, sf):
    bpe = T.FastBpe.at(T.vocabulary(), False)
    docs = {r["doc_id"]: len(bpe._whole(r["text"])) // 4 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in TC.query(spark, sf).collect()} == docs
