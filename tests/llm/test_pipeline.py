import corpus_pipeline
from rollcall.llm import QUERIES
from tests.llm.conftest import prose


def test_stages_keep_clean_documents_and_drop_the_others(spark, tmp_path):
    copy, item = prose(300, 120), prose(301, 40)
    rows = [(i, prose(i, 80), "en", "s", 1) for i in range(60)]
    rows += [(100, copy, "en", "s", 1), (101, copy + " one more word", "en", "s", 1), (102, item + " " + prose(5, 10), "en", "s", 1)]
    rows += [(200 + i, prose(400 + i, 60) + " idiot moron", "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert kept == {*range(60), 100}
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, severity string"


def put(spark, folder, docs, labels=(), items=()):
    """The three tables; documents have a column that a stage names its own after."""
    spark.createDataFrame([(i, t, "en", 1, "s") for i, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    put(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_nothing_to_learn_or_to_find(spark, tmp_path):
    text = prose(1, 70)
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, prose(2, 70)), (None, prose(3, 70)), (4, prose(4, 20000)), (5, prose(5, 70)), (5, prose(6, 70))]
    put(spark, tmp_path, docs)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = sorted(((r.doc_id, r.piece) for r in rows if r.doc_id != 4), key=repr)
    assert whole == sorted([(1, 0), (2, 0), (3, 0), (None, 0), (None, 0), (5, 0), (5, 0)], key=repr)
    assert sum(r.doc_id == 4 for r in rows) > 20


def test_rows_of_all_stages_are_those_of_brute_force(spark, tmp_path):
    """Every stage's decision, worked out on whole sets: what is toxic, repeated, copied, or of the benchmark goes."""
    import zlib

    import numpy as np

    from rollcall.llm.tokens import default_path, encoder
    from tests.llm import test_decontaminate, test_minhash

    shared = "\n".join(prose(800 + i, 12) for i in range(6))  # 72 words that stand in several documents
    items = [(1, prose(700, 50))]
    docs = [(i, prose(i, 90)) for i in range(40)]
    docs += [(100 + i, prose(50, 100) + f" end {i}") for i in range(6)]
    docs += [(200 + i, prose(210 + i, 60) + "\n" + shared + "\n" + prose(230 + i, 60)) for i in range(4)]
    docs += [(300 + i, prose(310 + i, 30 * i) + " " + items[0][1] + " tail") for i in range(3)]
    bad = [(400 + i, prose(410 + i, 50) + " scum idiot moron") for i in range(15)]
    put(spark, tmp_path, docs + bad, [(i, 0) for i, _ in docs] + [(i, 1) for i, _ in bad], items)

    kept = dict(docs)  # toxic documents go
    for i in (201, 202, 203):  # a repeated run goes from all but its first document
        kept[i] = kept[i].replace(shared + "\n", "")
    component = test_minhash.brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    found = {i for i, _ in test_decontaminate.brute(list(kept.items()), items)}
    kept = {i: t for i, t in kept.items() if i not in found}
    assert len(docs) - len(kept) == 5 + 3
    own = encoder(default_path())
    want = {i: np.append(own.ids(t), 0).astype("<u4") for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
