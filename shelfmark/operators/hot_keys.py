"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are counted per key and input partition, the counts are prefix-summed into
each partition's offset within the key, and rows are numbered from there. A
key's rows so fall into chunks of equal size, which are processed in parallel;
the chunks' states are then merged in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.runtime import drop_materialized, materialize

#: Chunks for each task of a shuffle that all rows together would make.
CHUNKS_A_TASK = 4


def _positions(df: DataFrame) -> DataFrame:
    """``df`` with each row's position ``_pos`` in its partition ``_pid``."""
    return df.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_pos", 33))


def _by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`_positions` with a key's rows side by side in every partition, in the order they came."""
    came = df.withColumn("_came", F.monotonically_increasing_id())
    return _positions(came.sortWithinPartitions(*keys, "_came").drop("_came"))


def partition_offsets(placed: DataFrame, keys: list[str], chunk_rows: int | None) -> tuple[DataFrame, int]:
    """(keys, _pid, _offset, _start) for keys with more rows than a chunk, and the rows of a chunk.

    A partition's rows are counted before the shuffle. Without ``chunk_rows`` a chunk
    is a fixed share of all rows, so that few keys can have more than one, whatever
    the number of rows. The results are written, so that Catalyst knows their size.
    """
    counts = materialize(placed.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start")), "counts")
    if chunk_rows is None:
        tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunk_rows = max(1, (counts.agg(F.sum("_n")).first()[0] or 0) // (CHUNKS_A_TASK * tasks))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        counts.withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_total") > chunk_rows)
        .select(*keys, "_pid", "_offset", "_start"),
        "offsets",
    )
    drop_materialized(counts)
    return offsets, chunk_rows


def with_chunks(df: DataFrame, keys: list[str], chunk_rows: int | None = None, stable: bool = False) -> DataFrame:
    """``df`` with ``chunk``: the number, within its key, of the chunk a row is in.

    Chunks of a key hold exactly ``chunk_rows`` rows but for the last, and follow
    the input's order; by default a chunk is a fixed share of all rows. Only keys
    with more rows than that are numbered; the rest are chunk 0. Null keys form a
    key of their own. ``stable`` says that ``df`` is a plain scan, whose partitions
    come out alike each time; anything else is written first with its positions,
    since offsets and rows must see the same partitions.
    """
    placed = _by_key(df, keys)
    return _chunked(placed if stable else materialize(placed, "chunk-input"), keys, chunk_rows)


def _chunked(placed: DataFrame, keys: list[str], chunk_rows: int | None) -> DataFrame:
    """A row's number is its partition's offset and its distance from the key's first row there."""
    if chunk_rows is not None and chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    names = [c for c in placed.columns if c not in ("_pos", "_pid")]
    offsets, rows = partition_offsets(placed.select(*keys, "_pos", "_pid"), keys, chunk_rows)
    o = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_pid").alias("_o_pid"), "_offset", "_start")
    on = F.col("_pid") == F.col("_o_pid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    number = F.expr(f"(_offset + _pos - _start) div {int(rows)}")
    return placed.join(o, on, "left").select(*names, F.coalesce(number, F.lit(0)).alias("chunk"))


def key_results(
    df: DataFrame,
    keys: list[str],
    chunk_states: dict[str, Column],
    merges: dict[str, Column],
    chunk_rows: int | None = None,
    stable: bool = False,
) -> DataFrame:
    """One row per key: ``chunk_states`` per chunk, merged per key by ``merges``.

    ``chunk_states`` aggregates the rows of a chunk; ``merges`` aggregates, over
    the columns of that name and ``chunk`` (their order), a key's chunk states.
    No task sees more than a chunk of a key, nor more chunk states of a key than
    it has chunks (see :func:`with_chunks`).
    """
    chunked = with_chunks(df, keys, chunk_rows, stable)
    states = chunked.groupBy(*keys, "chunk").agg(*[c.alias(n) for n, c in chunk_states.items()])
    return states.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str, chunk_rows: int | None = None) -> DataFrame:
    """Adds ``key_row`` (from 1) and ``running`` (sum of ``value`` so far) in the order given.

    The rows are range-partitioned on (keys, order) and sorted, so a large key
    lies across several partitions; these are the input partitions that offsets
    are taken over. Chunk sums are prefix-summed per key and added to the sums
    within the chunk. ``order`` must tell rows apart for the result to be unique;
    nulls come first; a null value adds nothing.
    """
    names = df.columns
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    spread = materialize(_positions(df.repartitionByRange(*by).sortWithinPartitions(*by)), "ordered")
    chunked = materialize(_chunked(spread, keys, chunk_rows), "chunked")
    drop_materialized(spread)
    by_order = [F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy(*keys, "chunk").orderBy(*by_order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunked.groupBy(*keys, "chunk")
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_s_{k}") for k in keys],
            F.col("chunk").alias("_s_chunk"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        )
    )
    on = F.col("chunk") == F.col("_s_chunk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return (
        chunked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(*by_order)))
        .join(starts, on)
        .select(*names, (F.col("_row") + F.col("_rows_before")).alias("key_row"), (F.col("_in") + F.col("_before")).alias("running"))
    )


def ordered_ranks(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's number within its key, from 1, in the order given.

    The rows are range-partitioned and sorted once; a number is the rows of the key
    in the partitions before, and those before it in its own.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    spread = materialize(_positions(df.repartitionByRange(*by).sortWithinPartitions(*by)), "ordered")
    # Chunks of one row; a key of one row isn't numbered and is its first.
    return _chunked(spread, keys, 1).withColumn(name, F.col("chunk") + 1).drop("chunk")


def content_key_totals(entries: DataFrame, chunk_rows: int | None = None, stable: bool = True) -> DataFrame:
    """(size, partial_hash, n_rows, n_bytes, n_drives) of all delivered file rows with a hash.

    A null size is a key value of its own; n_bytes is null where all sizes are.
    """
    files = entries.where("is_dir = 0 and partial_hash is not null").select("size", "partial_hash", "drive_id")
    return key_results(
        files,
        ["size", "partial_hash"],
        {"n_rows": F.count(F.lit(1)), "n_bytes": F.sum("size"), "drives": F.collect_set("drive_id")},
        {
            "n_rows": F.sum("n_rows"),
            "n_bytes": F.sum("n_bytes"),
            "n_drives": F.size(F.array_distinct(F.flatten(F.collect_list("drives")))).cast("long"),
        },
        chunk_rows,
        stable,
    )


def heavy_content_keys(entries: DataFrame, one_in: int = 50, chunk_rows: int | None = None, stable: bool = True) -> DataFrame:
    """(size, partial_hash) of the keys of :func:`content_key_totals` with one in ``one_in`` rows or more.

    No file row with a hash means no keys.
    """
    totals = materialize(content_key_totals(entries, chunk_rows, stable), "key-totals")
    rows = totals.agg(F.sum("n_rows")).first()[0] or 0
    return totals.where(F.col("n_rows") * one_in >= rows).select("size", "partial_hash")
