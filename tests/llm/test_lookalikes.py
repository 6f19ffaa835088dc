import itertools

import pytest

from shelfmark.llm.lookalikes import canonical_text, lookalike_classes, lookalike_pairs, lookalike_paths

SAME = [
    ["café", "café", "c​afé", "саfé", "ｃａｆé", "cafе́"],
    ["a b", "a b", "a b", "a b", "a　b", "a b"],
    ["co-op", "co‐op", "co‑op", "c­o-op", "﻿co-op"],
    ["ofﬁce", "office", "оﬃce", "ο‍ffice"],
    ["Ångström", "Ångström", "Ångström"],
    ["IMG", "ΙΜG", "ІМG", "ＩＭＧ"],
    ["ёж", "ёж"],
    ["µm", "μm"],
    ["Kelvin", "Kelvin"],
]
APART = ["file1", "file¹", "filel", "File1", "fi1e1", "fıle1", "fíle1", "file①", "file₁", "fìle1", "straße", "strasse", "o", "ø", "0", "O", "n", "ñ", "m", "rn", "½", "1/2", "👩‍🔬", "👩🔬", "", "|", "I"]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return [r.t for r in sorted(canonical_text(df, ["t"]).collect())]


def test_same_look_one_form(spark):
    got = iter(forms(spark, [t for group in SAME for t in group]))
    for group in SAME:
        assert len({next(got) for _ in group}) == 1, group


def test_other_looks_stay_apart(spark):
    got = forms(spark, APART)
    for (i, a), (j, b) in itertools.combinations(enumerate(got), 2):
        assert a != b, (APART[i], APART[j])


def test_rewriting_twice_changes_nothing_and_nulls_stay(spark):
    once = forms(spark, [t for group in SAME for t in group] + APART)
    assert forms(spark, once) == once
    df = spark.createDataFrame([(1, None, "é"), (2, "", None)], "id long, t string, u string")
    assert [tuple(r) for r in sorted(canonical_text(df, ["t", "u"]).collect())] == [(1, None, "é"), (2, "", None)]
    with pytest.raises(ValueError):
        canonical_text(df, ["id"])
    assert canonical_text(df.where("false"), ["t"]).count() == 0


def test_pairs_with_repeated_and_null_rows(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "x"), (5, None), (None, "a b"), (2, "a b"), (6, "А"), (7, "A"), (8, "a"), (9, "q'\"q"), (10, "q'\"​q")]
    df = spark.createDataFrame(rows, "id long, full_path string").withColumn("form", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    want = {(1, 2), (2, 3), (6, 7), (9, 10)}
    assert {tuple(r) for r in lookalike_pairs(df, "id", "full_path").collect()} == want
    got = [tuple(r) for r in lookalike_paths(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert lookalike_paths(df.where("false")).count() == 0


def test_a_text_held_by_most_rows(spark):
    rows = [(i, "сору") for i in range(300)] + [(1000, "copy"), (1001, "cоpy")]
    got = {tuple(r) for r in lookalike_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    want = {(i, k) for i in range(300) for k in (1000, 1001)} | {(1000, 1001)}
    assert got == want
    dealt = lookalike_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", pair_rows=7).collect()
    assert len(dealt) == len(want) and {tuple(r) for r in dealt} == want


def test_classes_name_every_row_and_count_its_links(spark):
    rows = [(3, "сору", "x"), (1, "copy", "x"), (2, "copy", "x"), (4, "other", "x"), (5, None, "x"), (None, "copy", "x"), (4, "other", "x"), (6, "", "x")]
    df = spark.createDataFrame(rows, "id long, t string, class_id string")
    assert sorted(tuple(r) for r in lookalike_classes(df, "id", "t").collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 4, 0), (4, 4, 0), (6, 6, 0)]
    assert lookalike_classes(df.where("false"), "id", "t").count() == 0


def test_long_texts_are_rewritten_whole(spark):
    (form,) = forms(spark, ["ж" + "е" * 200_000 + "​."])
    assert form == "ж" + "e" * 200_000 + "."


def test_ideographs_and_hangul(spark):
    same = [("一", "ー", "—"), ("囗", "口", "ロ"), ("戸", "戶"), ("黒", "黑"), ("\U00021fe8", "❬"), ("\uac01\ud55c", "\u1100\u1161\u11a8\u1112\u1161\u11ab")]
    got = iter(forms(spark, [f"a/{t}.txt" for group in same for t in group]))
    found = [{next(got) for _ in group} for group in same]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == len(same)
    assert len(set(forms(spark, ["가각", "가갂", "각가", "一二", "一三"]))) == 5
