import corpus_pipeline as P
from quarryline.llm import common as C
from quarryline.llm import simhash


def write(docs, bench, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_planted_rows(spark, docs_of, prose, tmp_path):
    item, passage = prose(40, 1), prose(60, 2)
    clean = [(i, "\n".join(prose(30, 100 * i + j) + "." for j in range(4))) for i in range(10, 40)]
    rows = [*clean, (1, "x y z " * 40), (2, None), (3, clean[0][1]), (4, prose(60, 5) + " " + item + " " + prose(60, 6) + "."), (5, prose(60, 7) + " " + passage + " " + prose(60, 8) + "."), (6, prose(60, 9) + " " + passage + " " + prose(60, 10) + ".")]
    folder = str(tmp_path)
    write(docs_of(rows), spark.createDataFrame([(1, item)], "item_id long, text string"), folder)
    docs, seen = C.table(spark, folder, "documents"), {}
    for name, stage in P.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, folder), "stage")
        assert docs.columns == docs_of([]).columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    everything = set(range(10, 40))
    assert set(seen["quality rules"]) == everything | {3, 4, 5, 6}
    assert set(seen["simhash near-dedup"]) == (everything - {10}) | {3, 4, 5, 6}
    cut = seen["substring dedup"]
    assert set(cut) == set(seen["simhash near-dedup"]) and passage in cut[5] and passage not in cut[6]
    assert all(cut[i] == t for i, t in clean if i > 10)
    assert set(seen["benchmark decontamination"]) == set(cut) - {4}
    packed = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(seen["benchmark decontamination"])


def test_empty_documents(spark, docs_of, tmp_path):
    write(docs_of([]), spark.createDataFrame([(1, "x")], "item_id long, text string"), str(tmp_path))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_against_brute_force(spark, sf):
    docs = C.table(spark, sf, "documents")
    kept = sorted(r["doc_id"] for r in P.near_dedup(spark, docs, sf).select("doc_id").collect())
    fp = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    parts = []
    for i in sorted(fp):
        near = [p for p in parts if any((fp[i] ^ fp[j]).bit_count() <= 4 for j in p)]
        parts = [p for p in parts if p not in near] + [sorted({i, *(j for p in near for j in p)})]
    assert kept == sorted(p[0] for p in parts)
