"""Differences between two copies of a dataset by set reconciliation.

The rows of either copy are hashed into a field and put in buckets by key. Where
the rows lie, the values of each bucket's characteristic polynomial at a few points
are computed, and only these sketches travel; those of a bucket's parts multiply to
the whole bucket's. From the quotient of the two copies' values the polynomials of
the differing hashes follow. A bucket whose bound on the degree proves too small
is taken again with twice as many points. The holders of the rows find the roots
among their own rows, and only those rows are fetched and compared field by field.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import field61
from shelfmark.runtime import map_arrow, materialize
from shelfmark.tables import latest_file_rows

#: Rows of one copy in a bucket, on average, but for rounding to a power of two.
BUCKET_ROWS = 1024
#: Differences in a bucket that the first round can find, plus one.
FIRST_BOUND = 32
#: Further points at which a result is verified; a wrong one passes with a chance under 2^-100.
CHECKS = 2
#: Points that are multiplied out at a time, which bounds a worker's memory.
_POINTS_AT_ONCE = 128

_SKETCH = "job long, bucket long, side int, n long, vals array<bigint>"
_SOLVED = "job long, bucket long, side int, poly array<bigint>"


def _row_hash(key: list[str], fields: list[str]) -> Column:
    # Whether a column is null goes in too, since the hash itself skips nulls.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in (*key, *fields)])
    return F.xxhash64(nulls, *key, *fields)


def _sketch(points: int):
    zs = field61.sample_points(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            job, bucket, side = (batch[c].to_numpy() for c in ("job", "bucket", "side"))
            order = np.lexsort((side, bucket, job))
            job, bucket, side = job[order], bucket[order], side[order]
            h = field61.to_element(batch["h"].to_numpy()[order])
            new = np.flatnonzero(np.r_[True, (job[1:] != job[:-1]) | (bucket[1:] != bucket[:-1]) | (side[1:] != side[:-1])])
            vals = np.concatenate([field61.segment_products(some[None, :] - h[:, None], new) for some in np.split(zs, range(_POINTS_AT_ONCE, points, _POINTS_AT_ONCE))], axis=1)
            flat = pa.array(vals.astype(np.int64).ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, points, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(job[new]), pa.array(bucket[new]), pa.array(side[new].astype(np.int32)), pa.array(np.diff(np.r_[new, len(h)])), pa.ListArray.from_arrays(offsets, flat)],
                names=["job", "bucket", "side", "n", "vals"],
            )

    return run


def _solve(bound: int, points: int):
    """Polynomials of the buckets in a partition: side 0 or 1, or 2 for 'not found yet'.

    A bucket comes out with side 3, all its rows to be fetched, where the next
    bound would need as many numbers as the bucket has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            vals = batch["vals"].values.to_numpy().astype(np.uint64).reshape(-1, points)
            for i, (j, b, s, n) in enumerate(zip(*(batch[c].to_pylist() for c in ("job", "bucket", "side", "n")))):
                at = held.setdefault((j, b), [0, 0, None, None])
                at[s] += n
                at[2 + s] = vals[i] if at[2 + s] is None else field61.mul(at[2 + s], vals[i])
        out: tuple[list, ...] = ([], [], [], [])
        one = np.ones(points, np.uint64)
        for (j, b), (n_a, n_b, v_a, v_b) in held.items():
            v_a, v_b = (one if v is None else v for v in (v_a, v_b))
            if n_a == n_b and np.array_equal(v_a, v_b):
                continue
            found = field61.reconcile(v_a.tolist(), v_b.tolist(), n_a, n_b, bound, CHECKS)
            if found:
                rows = [(s, p[::-1]) for s, p in enumerate(found) if len(p) > 1]
            else:
                rows = [(3 if 2 * bound >= n_a + n_b else 2, [])]
            for s, p in rows:
                for column, x in zip(out, (j, b, s, p)):
                    column.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))],
            names=["job", "bucket", "side", "poly"],
        )

    return run


def _roots(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch["poly"]
            starts, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.uint64)
            lengths = np.diff(starts)
            width = int(lengths.max())
            polys = np.zeros((len(lengths), width), np.uint64)
            at = np.arange(width)[None, :] - (width - lengths)[:, None]
            polys[at >= 0] = flat[starts[0] : starts[-1]]
            hit = field61.vanishes(field61.to_element(batch["h"].to_numpy()), polys)
            yield batch.select(names).filter(pa.array(hit))

    return run


def differing_rows(
    rows: DataFrame, key: list[str], fields: list[str], bucket_rows: int = BUCKET_ROWS, first_bound: int = FIRST_BOUND, report: list[dict] | None = None
) -> DataFrame:
    """The rows that one copy has and the other hasn't, in all of key and fields.

    ``rows`` has ``job`` (the pair of copies), ``side`` (0 or 1), the key and the
    fields; a side's keys are unique. Any number of rows may differ: a bucket whose
    next bound would be as large as its rows are many is fetched whole. To ``report``,
    if given, the number of buckets by outcome is added for each bound.
    """
    names = ["job", "side", *key, *fields]
    placed = rows.select("job", F.col("side").cast("int").alias("side"), *key, *fields, _row_hash(key, fields).alias("h"), F.xxhash64(F.lit("bucket"), "job", *key).alias("place"))
    # The rows stay where they are, a bucket's side by side; buckets are the first bits of the place.
    placed = materialize(placed.sortWithinPartitions("job", "side", "place"), "placed")
    bits = max(1, round(math.log2(max(1, placed.count() / (2 * bucket_rows)))))
    placed = placed.withColumn("bucket", F.shiftrightunsigned("place", 64 - bits)).drop("place")
    schema = placed.select(*names).schema
    pending, bound, found = None, first_bound, []
    while True:
        points = bound + CHECKS
        own = placed if pending is None else placed.join(pending, ["job", "bucket"], "left_semi")
        sketches = map_arrow(own.select("job", "bucket", "side", "h"), _sketch(points), _SKETCH)
        solved = materialize(map_arrow(sketches.repartition("job", "bucket"), _solve(bound, points), _SOLVED), "solved")
        candidates = own.join(solved.where("side < 2"), ["job", "bucket", "side"]).select(*names, "h", "poly")
        roots = map_arrow(candidates, _roots(names), schema)
        whole = own.join(solved.where("side = 3").select("job", "bucket"), ["job", "bucket"], "left_semi").select(*names)
        found.append(roots.unionByName(whole))
        pending = solved.where("side = 2").select("job", "bucket")
        if report is not None:
            kinds = solved.select("job", "bucket", F.when(F.col("side") < 2, "solved").when(F.col("side") == 2, "again").otherwise("whole").alias("kind")).distinct().groupBy("kind").count()
            report.append({"bound": bound, "rows": own.count(), **{r["kind"]: r["count"] for r in kinds.collect()}})
        if pending.isEmpty():
            break
        bound *= 2
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def field_differences(rows: DataFrame, key: list[str], fields: dict[str, bool], **options) -> DataFrame:
    """(job, key, diff): 'only_a', 'only_b', or the name of each differing field.

    ``fields`` maps a field to whether a null counts: True means that a null differs
    from a value, False that the field is compared only where both have one.
    Null keys match nothing and are left out; two nulls are equal.
    """
    keyed = rows
    for k in key:
        keyed = keyed.where(F.col(k).isNotNull())
    differing = materialize(differing_rows(keyed, key, list(fields), **options), "differing")

    def side(n: int, tag: str) -> DataFrame:
        return differing.where(F.col("side") == n).select("job", *key, *[F.col(f).alias(f"{tag}_{f}") for f in fields], F.lit(1).alias(f"in_{tag}"))

    both = side(0, "a").join(side(1, "b"), ["job", *key], "full")
    cases = [F.when(F.col("in_b").isNull(), F.lit("only_a")), F.when(F.col("in_a").isNull(), F.lit("only_b"))]
    matched = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for f, nulls_count in fields.items():
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        differs = ~a.eqNullSafe(b) if nulls_count else F.coalesce(a != b, F.lit(False))
        cases.append(F.when(matched & differs, F.lit(f)))
    return both.select("job", *key, F.explode(F.array_compact(F.array(*cases))).alias("diff"))


def copy_differences(entries: DataFrame, snapshots: DataFrame, drives: DataFrame, copy_pairs: DataFrame, **options) -> DataFrame:
    """(pair_id, path_id, diff) of the pairs of drives in ``copy_pairs``, over their latest snapshots.

    A label names the drive of that exact label, of several the one with the lowest
    id. A pair whose label is null or names no drive is left out, since there's
    nothing to compare; a drive without delivered snapshots counts as empty.
    """
    ids = drives.where("label is not null").groupBy("label").agg(F.min("id").alias("drive_id"))
    sides = copy_pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("label_a").alias("label"), F.lit(0).alias("side")), F.struct(F.col("label_b").alias("label"), F.lit(1).alias("side")),
    )).alias("s")).select("pair_id", "s.*").join(ids, "label")
    complete = sides.groupBy("pair_id").agg(F.countDistinct("side").alias("n")).where("n = 2").select("pair_id")
    sides = materialize(sides.join(complete, "pair_id").select(F.col("pair_id").alias("job"), "side", "drive_id").distinct(), "sides")
    wanted = snapshots.join(sides.select("drive_id").distinct(), "drive_id", "left_semi")
    files = latest_file_rows(entries, wanted, "path_id", "size", "partial_hash", "full_hash").join(sides, "drive_id")
    fields = {"size": True, "partial_hash": True, "full_hash": False}
    return field_differences(files, ["path_id"], fields, **options).withColumnRenamed("job", "pair_id")
