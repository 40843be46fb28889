import os
from itertools import combinations

import pytest
import sentencepiece

from tallylog.llm import op8_pieces as m

pytestmark = pytest.mark.skipif(not os.path.exists(m.MODEL), reason="no vocabulary file")
TEXTS = ["", None, "Hello world", "  a  b", "日本語 漢字😀 x²½ é漢", "a\tb\n\n  c   ", "x" * 100 + " " * 50 + "y", " ", "ab12" * 30, "aaaa aaaaa", "THE!! OF%%% the, of. the", "ﬁ ①", "Ünïcödé wörds für 1234567.89 €"]


@pytest.fixture(scope="module")
def vocabulary():
    return m.vocabulary()


@pytest.mark.parametrize("dictionary", [3])
def test_same_ids_as_the_library(spark, docs_of, vocabulary, dictionary):
    lib = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (2, "Hello world"), (2, "Hello world")]
    got = m.encode(docs_of(rows), vocabulary, dictionary).collect()
    want = sorted(((i, lib.encode(t or "")) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=repr) == want
    assert m.encode(docs_of([]), vocabulary).count() == 0


def test_round_trip(spark, docs_of, vocabulary):
    texts = [t for t in TEXTS if t is not None]
    coded = m.encode(docs_of(list(enumerate(texts))), vocabulary)
    assert {r["doc_id"]: r["text"] for r in m.decoded(coded, vocabulary).collect()} == dict(enumerate(texts))
    digest = m.encode(docs_of(list(enumerate(texts))), vocabulary, digest=True).collect()
    assert all(r["round_trip"] for r in digest) and {r["doc_id"]: r["n_ids"] for r in digest} == {r["doc_id"]: len(r["ids"]) for r in coded.collect()}


def test_heap_merges_equal_the_library(vocabulary):
    lib = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
    ids = {p: i for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.matched, strict=True)) if ok}
    for t in TEXTS:
        if t:
            assert m.merge_long(m.MARK + t.replace(" ", m.MARK), ids, vocabulary.scores, vocabulary.bytes_at) == lib.encode(t)


def test_viterbi_takes_the_best_sum(spark):
    pieces = {"a": -1.0, "b": -1.5, "c": -2.0, "ab": -1.2, "bc": -1.1, "abc": -4.0, "ca": -0.5, "cab": -0.9}
    v = m.Vocabulary(tuple(pieces), tuple(pieces.values()), (True,) * len(pieces), 100)
    words = ["abc", "cab", "abcab", "ccc", "bcabca", "a"]

    def brute(w):
        best = None
        for k in range(len(w)):
            for cut in combinations(range(1, len(w)), k):
                parts = [w[i:j] for i, j in zip((0, *cut), (*cut, len(w)), strict=True)]
                if all(p in pieces for p in parts):
                    s = sum(pieces[p] for p in parts)
                    best = max(best or (s, parts), (s, parts), key=lambda x: x[0])
        return [list(pieces).index(p) for p in best[1]]

    df = spark.createDataFrame([(w,) for w in words], "unit string")
    assert {r["unit"]: list(r["ids"]) for r in m.lattice(df, [], v, "viterbi").collect()} == {w: brute(w) for w in words}


def test_units_never_cut_a_piece(vocabulary):
    import regex

    unit = regex.compile(vocabulary.unit)
    for p, ok in zip(vocabulary.pieces, vocabulary.matched, strict=True):
        assert not ok or unit.fullmatch(p)


def test_query_against_the_library(spark, sf_dir):
    import hashlib

    import numpy as np

    lib = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(lib.encode(r["text"] or ""), dtype="<i4")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    got = m.op8_pieces(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_ids"], r["ids_sha256"]) for r in got} == want and all(r["round_trip"] for r in got)


def test_unigram_vocabularies_are_refused(spark, docs_of):
    v = m.Vocabulary(("a", "b"), (-1.5, -2.25), (True, True), 100)
    with pytest.raises(ValueError, match="viterbi"):
        m.encode(docs_of([(1, "ab")]), v)
