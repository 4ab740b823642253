import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.llm.lookalike import _code_points, _pairs, _replacement, _strings, consistent_text, fold, lookalike_members, lookalike_pairs

PAIRS = _pairs()
LETTERS = st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=40)
MARKED = st.text(st.sampled_from("aeouAEéêḗ" + "".join(map(chr, range(0x300, 0x32A))) + "가각각ﬁаеο​­ "), max_size=20)


def plain(text):
    return unicodedata.normalize("NFC", "".join(_replacement(ord(c), PAIRS) for c in text))


def folded(texts):
    column = pa.array(texts, pa.string())
    cps, row = fold(*_code_points(column.fill_null("")))
    return _strings(cps, row, len(texts), column.is_valid()).to_pylist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS, MARKED), min_size=1, max_size=8))
def test_equals_the_plain_way(texts):
    assert folded(texts) == [None if t is None else plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.one_of(LETTERS, MARKED))
def test_a_form_is_its_own_form(text):
    once = folded([text])[0]
    assert folded([once])[0] == once


def test_what_matters_and_what_does_not():
    same = ["café A", "café A", "cаfé Α", "ｃａｆé　A", "ca​fé A", "caf­é A"]
    assert len(set(folded(same))) == 1
    assert len(set(folded(["cafe A", "café A", "Café A", "café, A", "café  A"]))) == 5


def test_shares_of_long_texts(spark):
    long = "xа" * 700_000
    df = spark.createDataFrame([(1, long, 1), (2, None, 1), (3, "", 1), (4, "ﬁn", 1)], "doc_id long, text string, form int")
    got = {r["doc_id"]: r["form"] for r in consistent_text(df).collect()}
    assert got == {1: "xa" * 700_000, 2: None, 3: "", 4: "fin"}


def test_pairs(spark):
    rows = [(1, "nó"), (2, "nó"), (3, "nó"), (4, "no"), (5, None), (6, ""), (7, "​"), (8, "​​"), (9, "zwei"), (10, "zwei")]
    members = lookalike_members(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in lookalike_pairs(members).collect()} == {(1, 2), (1, 3)}
    assert lookalike_pairs(lookalike_members(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_whole_table_against_plain_python(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    by_form = {}
    for r in docs.select("doc_id", "text").collect():
        if r["text"] and plain(r["text"]).strip(" "):
            by_form.setdefault(plain(r["text"]), []).append((r["doc_id"], r["text"]))
    want = {(a, b) for g in by_form.values() for a, s in g for b, t in g if a < b and s != t}
    assert {tuple(r) for r in lookalike_pairs(lookalike_members(docs)).collect()} == want


def test_columns_and_rows_stay(spark):
    df = spark.createDataFrame([(1, "a", "k"), (1, "a", "k")], "doc_id long, text string, id string")
    out = consistent_text(df)
    assert out.columns == ["doc_id", "text", "id", "form"] and out.count() == 2
    assert np.all([r["form"] == "a" for r in out.select(F.col("form")).collect()])


def test_classes_have_a_row_per_document(spark):
    from turnloom.llm.lookalike import lookalike_classes, lookalike_members

    rows = [(5, "caf\u00e9"), (3, "cafe\u0301"), (9, "caf\u00e9"), (1, "other"), (2, None), (4, "")]
    got = lookalike_classes(lookalike_members(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(tuple(r) for r in got) == [(3, 3, 3, 2), (5, 3, 3, 2), (9, 3, 3, 2)]


def test_bytes_that_are_no_text_and_lone_surrogates():
    import numpy as np
    import pyarrow as pa

    from turnloom.llm.lookalike import _code_points, _strings

    broken = pa.array([b"ab", b"\xff\xfec", b"\xc3\xa9"], pa.binary()).view(pa.string())
    cps, row = _code_points(broken)
    assert row.tolist() == [0, 0, 1, 1, 1, 2] and "".join(map(chr, cps)) == "ab\ufffd\ufffdc\u00e9"
    out = _strings(np.array([97, 0xD800, 98], np.uint32), np.array([0, 0, 1]), 2, pa.array([True, True]))
    assert out.to_pylist() == ["a\ufffd", "b"]
