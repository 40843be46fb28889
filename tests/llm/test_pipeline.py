import os

import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] == sizes[5] > 0


def test_order_of_stages():
    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "SentencePiece encoding"]


def test_against_brute_force(spark, docs_of, tmp_path):
    """Four of the stages in plain Python behind the classifier's own verdicts, on odd rows, too."""
    import random

    import sentencepiece
    from test_op2_decontaminate import brute as contaminated
    from test_op9_lines import brute as cut
    from test_similar import smallest_of_each

    from tallylog.llm import op8_pieces
    from tallylog.llm.op1_quality import keep_good

    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    item = words(14)
    texts = [f"{words(30)}\nShared line\n{words(20)}" for _ in range(14)] + [words(40) for _ in range(20)]
    texts += [texts[20] + " tail", texts[21], f"{words(9)} {item} {words(9)}", "Shared line", "", words(4000)]
    rows = [*enumerate(texts), (3, texts[3]), (None, None), (None, texts[22] + " x")]
    spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = [(x["doc_id"], x["text"]) for x in keep_good(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()]
    lines = [(i, t) for i, _, _, t in cut(good, 10, 1)]
    named = {(-1, k) if i is None else (i, 0): t for k, (i, t) in enumerate(sorted(set(lines), key=repr))}
    order = {k: n for n, k in enumerate(sorted(named, key=lambda k: (k[0] < 0, k)))}
    kept = smallest_of_each([(order[k], t) for k, t in named.items()])
    left = [(None if k[0] < 0 else k[0], t) for k, t in named.items() if order[k] in kept]
    clean = [i for i, _, hit, _ in contaminated(left, [(1, item), (2, None)], 10) if not hit]
    lib = sentencepiece.SentencePieceProcessor(model_file=op8_pieces.MODEL)
    want = sorted(((i, lib.encode(t or "")) for i, t in left if i in clean), key=repr)
    assert sorted(((x["doc_id"], list(x["ids"])) for x in p.run(spark, str(tmp_path)).collect()), key=repr) == want
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
