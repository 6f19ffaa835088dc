import pyarrow as pa
import pytest

from shelfmark.llm.quality import RULES, measure, not_prose, text_quality

COMMON = pa.array("the of and to in a is that for it was on with as at by this o de da que e em um para não por el la los y en se no der die das und ist nicht и в не на что".split())

PROSE = [
    "The old drive was scanned again, and the report is on the shelf.",
    "why is the drive counted twice",
    "> The copy was left out of the comparison.\n> That explains the space.",
    "THE INDEX WAS NOT FINISHED BY THE TIME THE DISK WAS FULL.",
    "It took two hours to walk\nthe old archive and that is why\nthe group was left open.",
    "O relatório ficou na pasta de fotografias e não foi lido.",
    "Между тем отчёт не был прочитан, и в папке ничего не изменилось.",
    "古いディスクをもう一度調べました。合計は同じでした。",
    "Vídeos/férias/run_b_366の大きさは28/07/2020に696 MBでした。",
    "Most of the duplic<|endoftext|>ates sit in exports, and the index was left out of it.",
    "<p>The box was under the desk for a year.</p>",
    "About Fotos/2018, Música/ao vivo and lab/run_07: the totals agree in all of them.",
    "# Heading\nThe plan was put on hold because the cable had come loose in the night.",
]
OTHER = [
    "- read errors\n- blue label\n- photo set",
    "1. the index 977 GB\n2. the copy 12.8 TB",
    "| folder | files |\n|---|---|\n| the index | 3 |",
    "blue label;59425153;757 MB\ntape box;535227829;366 GB",
    "photo set,493,138 MB\ntape box,503,49 MB",
    "Lab/run_a/cell_1.csv\nLab/run_b/the plate_2.csv",
    "cp -p 'Lab/a.csv'\nrm -- 'Lab/b.csv'",
    "2021-11-10 09:00:48 INFO walk Lab/a rc=7\n2021-11-10 09:00:49 WARN walk Lab/b rc=1",
    "label: the index\nfiles: 3\n\nlabel: the copy\nfiles: 4",
    "copy copy copy copy copy copy copy copy copy copy copy",
    "Xq zvrtk bgfhj wqplm zzxcv qwrtp.",
    "h7+MCM05DaQN3xuMNiCB3SwHsQtTkYainkrNgAb93aaY50wXe8jPI8Cu",
    "the of and to in a is that for it was on with as at by this",
    "ext:tar.gz size>33GB\nname:trial modified:2021",
    "ação; blue label; read errors; photo set; pão",
    "├── raw\n│   └── plate_3\n└── docs",
    "The plan was read again.\n- a\n- b\n- photo set\n- blue label\n- read errors of the disk",
    "00000000  cd d6 27 0a 9b 5e 00 c5",
    "#####\n=====",
]


def share(text):
    return measure([text], COMMON)["prose_share"][0]


@pytest.mark.parametrize("text", PROSE, ids=range(len(PROSE)))
def test_sentences_are_prose(text):
    assert share(text) >= 0.5


@pytest.mark.parametrize("text", OTHER, ids=range(len(OTHER)))
def test_lists_tables_and_junk_are_not(text):
    assert share(text) < 0.5


def test_a_texts_measure_does_not_depend_on_its_neighbours():
    texts = [*PROSE, None, "", *OTHER, "x" * 100_000]
    together = measure(texts, COMMON)
    for i, t in enumerate(texts):
        alone = measure([t], COMMON)
        assert {k: v[0] for k, v in alone.items()} == {k: v[i] for k, v in together.items()}


def test_statistics_and_reasons(spark):
    rows = [(1, "The cat sat.\nThe cat sat.", "x"), (2, None, "x"), (3, " \n ", "x"), (3, "- a\n- b", "x"), (None, "Stop...", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    words = spark.createDataFrame([("en", "The"), (None, None)], "lang string, word string")
    got = {(r.doc_id, r.n_words): r for r in text_quality(docs, words).collect()}
    first = got[1, 6]
    assert first.punctuated_lines == 1 and first.repeated_line_chars == 0.5 and first.n_common == 2 and first.mean_word_len == 3
    assert {"few_words", "repeated_lines"} <= set(first.reasons.split(","))
    for empty in (got[2, 0], got[3, 0]):
        assert empty.prose_share == 0 and "not_prose" not in empty.reasons
    assert got[3, 2].bullet_lines == 1 and "not_prose" in got[3, 2].reasons and got[3, 2].main_reason == "bullets"
    assert got[3, 2].passage_reasons.split(",")[0] == "bullets" and first.passage_reasons == ""
    assert [r.doc_id for r in not_prose(docs, words).collect()].count(3) == 1
    assert text_quality(docs.where("false"), words.where("false")).count() == 0


def test_each_rule_has_a_text_that_fails_it():
    texts = {
        "bullets": "* a list of things that we have in the box\n* and the other things on it",
        "symbols": "a==b && c||d {x} <y> #z @q $$$ %%% ^^^ &&& *** ~~~",
        "non_alphabetic": "12 345 6789 a 12.5 77 8 9 10 of 11",
        "word_length": "aGVsbG8gd29ybGQgdGhpcyBpcyBhIGxvbmcgdG9rZW4gb2Ygbm9uc2Vuc2U",
        "few_common_words": "Krimb plosk vatter quonim dresk pallov fimter grodek.",
        "only_common_words": "the of and to in a is that for it was on with as at by this.",
        "repeated_words": "scan " * 40 + ".",
        "short_open_lines": "blue label\nphoto set\nthe box",
        "separators": "red, green, blue, the sea, a tree, on top",
        "columns": "the oldest folder of all that is on it    12 GB\nthe newest folder of all that is on it    13 GB",
    }
    assert list(texts) == list(RULES)
    for rule, text in texts.items():
        got = measure([text], COMMON)
        assert got["not_prose"][0] and rule in got["passage_reasons"][0].split(","), (rule, got["passage_reasons"][0])


def test_passages_are_weighed_by_their_characters():
    prose = "The old drive was scanned again, and the report is on the shelf of the lab."
    few, many = "- a b\n- c d", "\n".join(f"- item {i} of the box" for i in range(20))
    assert not measure([f"{prose}\n{few}"], COMMON)["not_prose"][0] and measure([f"{prose}\n{many}"], COMMON)["not_prose"][0]
    mixed = measure([f"{prose}\n{few}"], COMMON)
    assert mixed["passage_reasons"][0].startswith("bullets") and 0.5 < mixed["prose_share"][0] < 1 and mixed["main_reason"][0] == ""
