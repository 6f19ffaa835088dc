import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.hot_keys import content_key_totals, heavy_content_keys, key_results, ordered_ranks, running_totals, with_chunks

SCHEMA = "k string, v long, o long, chunk_note string"


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(1)
    rows = [(random.choice(["hot", "hot", "hot", None, "b", f"k{i % 50}"]), random.choice([None, 1, 2, 3]), i, "n") for i in range(2000)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


@pytest.mark.parametrize("chunk_rows", [1, 7, 100, 5000])
def test_chunks_are_full_and_complete(skewed, chunk_rows):
    rows, df = skewed
    sizes = {(r.k, r.chunk): r["count"] for r in with_chunks(df, ["k"], chunk_rows).groupBy("k", "chunk").count().collect()}
    per_key = defaultdict(int)
    for k, *_ in rows:
        per_key[k] += 1
    expected = {(k, c): min(chunk_rows, n - c * chunk_rows) for k, n in per_key.items() for c in range(-(-n // chunk_rows))}
    assert sizes == expected


def test_key_results_match_plain_grouping(skewed):
    rows, df = skewed
    got = key_results(df, ["k"], {"n": F.count("*"), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, 13)
    plain = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("chunk_rows", [3, 64, 10_000])
def test_running_totals_match_a_loop(skewed, chunk_rows):
    rows, df = skewed
    expected, state = {}, defaultdict(lambda: [0, 0])
    for k, v, o, _ in sorted(rows, key=lambda r: r[2]):
        state[k][0] += 1
        state[k][1] += v or 0
        expected[o] = tuple(state[k])
    got = {r.o: (r.key_row, r.running) for r in running_totals(df, ["k"], ["o"], "v", chunk_rows).collect()}
    assert got == expected


def test_chunks_are_a_share_of_all_rows_by_default(skewed):
    rows, df = skewed
    shared = with_chunks(df, ["k"])
    # 2000 rows, 4 shuffle tasks with 4 chunks each: 125 rows a chunk.
    sizes = sorted(r["count"] for r in shared.where("k = 'hot'").groupBy("chunk").count().collect())
    hot = sum(r[0] == "hot" for r in rows)
    assert sizes == sorted([125] * (hot // 125) + [hot % 125] * (hot % 125 > 0))
    assert {r.chunk for r in shared.where("k like 'k%'").collect()} == {0}
    # Each chunk's rows come before those of the next, in the order of the input.
    ranges = shared.where("k = 'hot'").groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()
    assert [r.n for r in ranges[:-1]] == [125] * (len(ranges) - 1)


def test_ranks_in_order_match_a_sort(skewed):
    rows, df = skewed
    expected, seen = {}, defaultdict(int)
    for k, _, o, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2])):
        seen[k] += 1
        expected[o] = seen[k]
    assert {r.o: r["rank"] for r in ordered_ranks(df, ["k"], ["o"]).collect()} == expected


def test_empty_input_and_bad_chunk(spark, skewed):
    none = spark.createDataFrame([], SCHEMA)
    assert with_chunks(none, ["k"]).count() == 0
    assert running_totals(none, ["k"], ["o"], "v").count() == 0
    with pytest.raises(ValueError):
        with_chunks(skewed[1], ["k"], 0)


def test_content_keys_with_nulls(spark):
    rows = [(0, None, b"a", 1)] * 60 + [(0, 5, b"a", i % 3) for i in range(39)] + [(0, 7, b"b", None)] + [(0, 1, None, 1)] * 50 + [(1, None, b"d", 1)] * 50 + [(None, 1, b"e", 1)]
    e = spark.createDataFrame(rows, "is_dir int, size long, partial_hash binary, drive_id long")
    totals = {(r["size"], bytes(r["partial_hash"])): (r["n_rows"], r["n_bytes"], r["n_drives"]) for r in content_key_totals(e, 10, stable=False).collect()}
    assert totals == {(None, b"a"): (60, None, 1), (5, b"a"): (39, 195, 3), (7, b"b"): (1, 7, 0)}
    assert {tuple(r) for r in heavy_content_keys(e, 50, 10, stable=False).collect()} == {(None, b"a"), (5, b"a")}
    assert heavy_content_keys(e.where("false"), stable=False).count() == 0


def test_queries_give_hashes_as_hex(spark, tmp_path):
    from shelfmark.problem_queries import QUERIES

    hot, rare = bytes([0xAB, 0x00, 0xFF, *range(13)]), bytes(range(16))
    rows = [(0, 5, hot, 1)] * 60 + [(0, None, rare, 2)] + [(1, 5, rare, 2), (0, 5, None, 2)]
    spark.createDataFrame(rows, "is_dir int, size long, partial_hash binary, drive_id long").write.parquet(f"{tmp_path}/entries_core.parquet")
    found = QUERIES["p4_found"](spark, str(tmp_path))
    assert found.dtypes == [("size", "bigint"), ("partial_hash", "string")]
    assert [tuple(r) for r in found.collect()] == [(5, hot.hex())]
    totals = {(r["size"], r["partial_hash"]): (r["n_rows"], r["n_bytes"], r["n_drives"]) for r in QUERIES["p4_key_totals"](spark, str(tmp_path)).collect()}
    assert totals == {(5, hot.hex()): (60, 300, 1), (None, rare.hex()): (1, None, 1)}
