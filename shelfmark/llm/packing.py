"""Filling containers of fixed capacity: exact complements first, then best fit.

Items of one length are alike, so the plan is made on counts per length, of which
there are at most as many as a container holds tokens. It says which ranks of
each length go to which containers; rows get their rank by exact offset chunking
and look their container up. Each kind is planned by one task, from its counts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfmark.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from shelfmark.operators.hot_keys import with_chunks
from shelfmark.runtime import materialize, ship

#: Kinds of containers that are packed together.
KINDS_AT_ONCE = 100


class _Plan:
    """Placements (length, first rank, items, first container, containers)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        #: Items of each length that are left.
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError("lengths must lie between 1 and the capacity")
            self.left[length] = n
        self.next_rank = [0] * (capacity + 1)
        self.placements: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        #: Whether two lengths may sum to this. Items only get fewer, so a sum that has failed never comes back.
        self.pairs = self._pair_sums()

    def _pair_sums(self) -> np.ndarray:
        lengths = np.flatnonzero(self.left)
        sums = np.zeros(2 * self.capacity + 2, bool)
        for x in lengths[2 * lengths <= self.capacity].tolist():
            # The smaller of the two is at most half.
            sums[lengths + x] = True
        return sums[: self.capacity + 1]

    def put(self, length: int, each: int, first: int, containers: int) -> None:
        """``each`` items of ``length`` into each of ``containers`` containers."""
        n = each * containers
        self.placements.append((length, self.next_rank[length], n, first, containers))
        self.next_rank[length] += n
        self.left[length] -= n

    def take(self, combination: tuple[int, ...]) -> bool:
        """Fill as many containers with this exact combination as the counts allow."""
        distinct = {x: combination.count(x) for x in combination}
        k = min(int(self.left[x]) // m for x, m in distinct.items())
        if not k:
            return False
        for x, m in distinct.items():
            self.put(x, m, self.containers, k)
        self.containers += k
        return True

    def fill_pair(self, rest: int, head: tuple[int, ...]) -> bool:
        """Combinations of ``head`` and two lengths that sum to ``rest``; the most uneven first."""
        taken, half = False, rest // 2
        both = (self.left[1 : half + 1] > 0) & (self.left[rest - 1 : rest - half - 1 : -1] > 0)
        for a in (np.flatnonzero(both) + 1).tolist():
            if not self.left[head[0]]:
                break
            if self.left[a] and self.left[rest - a]:
                taken |= self.take((*head, a, rest - a))
        if not both.any():
            self.pairs[rest] = False
        return taken

    def exact(self) -> None:
        for length in np.flatnonzero(self.left)[::-1].tolist():
            gap = self.capacity - length
            if not gap:
                self.take((length,))
                continue
            if self.left[length] and self.left[gap]:
                self.take((length, gap))
            if self.left[length] and gap > 1 and self.pairs[gap]:
                self.fill_pair(gap, (length,))
            if self.left[length] and gap > 2:
                self.fill_triples(length, gap)

    def fill_triples(self, length: int, gap: int) -> None:
        # The largest of three is at least a third.
        least = -(-gap // 3)
        third = np.arange(gap - 2, least - 1, -1)
        for c in third[(self.left[third] > 0) & self.pairs[gap - third]].tolist():
            if not self.left[length]:
                return
            if self.left[c] and self.pairs[gap - c]:
                self.fill_pair(gap - c, (length, c))

    def best_fit(self) -> None:
        gaps: dict[int, list[tuple[int, int]]] = {}
        bits = 0
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                fitting = bits >> length
                if not fitting:
                    each = min(self.capacity // length, int(self.left[length]))
                    first, k = self.containers, int(self.left[length]) // each
                    self.containers += k
                    gap = self.capacity
                else:
                    gap = (fitting & -fitting).bit_length() - 1 + length
                    first, k = gaps[gap].pop()
                    if not gaps[gap]:
                        bits &= ~(1 << gap)
                    n = int(self.left[length])
                    if k > n:
                        gaps[gap].append((first + n, k - n))
                        bits |= 1 << gap
                        k = n
                    each = min(gap // length, n // k)
                self.put(length, each, first, k)
                gap -= each * length
                if gap:
                    gaps.setdefault(gap, []).append((first, k))
                    bits |= 1 << gap


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements of ``counts`` (items per length) and the number of containers they take.

    Item ``rank`` of a placement (length, first rank, items, first container, k)
    lies in container first + (rank - first rank) mod k. Lengths, in falling order,
    are completed by one, two or three other lengths that fill a container exactly,
    as often as the counts allow; what is left goes, longest first, where it
    leaves the least room. The work and the number of placements depend on the
    number of distinct lengths, not on the number of items.
    """
    plan = _Plan(counts, capacity)
    plan.exact()
    plan.best_fit()
    return plan.placements, plan.containers


def _items(sizes: DataFrame, capacities: list[int], id_col: str, size_col: str) -> DataFrame:
    """(code, capacity, id, piece, from_token, length): texts over the capacity cut at its multiples; code is a kind's place."""
    kinds = F.posexplode(F.array(*[F.lit(c).cast("long") for c in capacities])).alias("code", "capacity")
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(`{size_col}` - 1) div capacity")))
    start = F.col("piece") * F.col("capacity")
    return sizes.select(id_col, size_col, kinds).select("*", F.explode(pieces).alias("piece")).select(
        "code", "capacity", id_col, "piece", start.alias("from_token"), F.least(F.col("capacity"), F.col(size_col) - start).alias("length")
    )


_PLAN = "code int, length long, low long, items long, first long, width long, step long"


def _plan_kind(table: pa.Table) -> pa.Table:
    """The placements of one kind, whose counts per length are at most as many as its capacity."""
    code, capacity = table["code"][0].as_py(), table["capacity"][0].as_py()
    counts = dict(zip(table["length"].to_pylist(), table["n"].to_pylist()))
    empty = counts.pop(0, 0)
    placed, total = plan_containers(counts, capacity)
    if empty:
        placed.append((0, 0, empty, 0, max(1, total)))
    at = np.array(placed, np.int64).reshape(-1, 5)
    # Ranks are looked up in steps as long as a length's placements are on average.
    per_length, inverse, n = np.unique(at[:, 0], return_inverse=True, return_counts=True)
    held = np.bincount(inverse, at[:, 2], len(per_length)).astype(np.int64)
    step = np.maximum(1, held // np.maximum(1, n))[inverse] if len(at) else at[:, 0]
    columns = [np.full(len(at), code, np.int32), *at.T, step]
    return pa.table(columns, names=["code", "length", "low", "items", "first", "width", "step"])


def pack(sizes: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container_kind, container, id, piece, from_token, length) of every row for every kind.

    ``sizes`` has the items' sizes, ``containers`` container_kind and
    capacity_tokens. Only an item longer than the capacity is split: into full
    pieces and one rest. Items of size 0 (or null) are spread over the containers
    and take no room. Repeated and null ids are items like others. Kinds without a
    positive capacity hold nothing and are left out; no items, no rows. Each kind is
    planned by a task of its own, from its counts per length. ``containers`` is
    a table of parameters: its kinds are taken KINDS_AT_ONCE at a time.
    """
    sizes = sizes.select(id_col, F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias(size_col))
    kinds = [tuple(r) for r in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().sort("container_kind", "capacity_tokens").toLocalIterator()]
    if not kinds:
        sizes, kinds = sizes.where("false"), [(None, 1)]
    label = containers.schema["container_kind"].dataType
    parts = [_pack_kinds(sizes, kinds[i : i + KINDS_AT_ONCE], id_col, size_col, label) for i in range(0, len(kinds), KINDS_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def _pack_kinds(sizes: DataFrame, kinds: list[tuple], id_col: str, size_col: str, label: DataType) -> DataFrame:
    keys = ["code", "capacity", "length"]
    items = _items(sizes, [c for _, c in kinds], id_col, size_col)
    ranked = materialize(with_chunks(items, keys, 1).withColumnRenamed("chunk", "rank"), "ranked")
    counts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ship(sizes.sparkSession)
    plan = materialize(counts.groupBy("code").applyInArrow(_plan_kind, _PLAN), "plan")
    # A placement is looked up by the steps that its ranks reach into.
    steps = plan.select("code", "length", "step").distinct()
    reach = F.sequence(F.expr("low div step"), F.expr("(low + items - 1) div step"))
    placements = plan.select("code", "length", "low", "items", "first", "width", F.explode(reach).alias("at"))
    names = F.array(*[F.lit(k).cast(label) for k, _ in kinds])
    return (
        ranked.join(steps, ["code", "length"])
        .withColumn("at", F.expr("rank div step"))
        .join(placements, ["code", "length", "at"])
        .where("rank >= low and rank < low + items")
        .select(
            F.element_at(names, F.col("code") + 1).alias("container_kind"),
            F.expr("first + (rank - low) % width").alias("container"),
            id_col, "piece", "from_token", "length",
        )
    )


def pack_corpus(docs: DataFrame, containers: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """:func:`pack` over all documents, sized in tokens of ``vocabulary``."""
    return pack(count_tokens(docs, vocabulary=vocabulary), containers)


def packing_summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_items, n_tokens, n_containers, least): per kind.

    ``least`` is the number of containers that the tokens would fill if any text
    could be cut anywhere, a bound that no packing can beat.
    """
    used = packed.groupBy("container_kind", "container").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    per = used.groupBy("container_kind").agg(F.sum("n").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"))
    return per.join(containers.select("container_kind", "capacity_tokens"), "container_kind").select(
        "container_kind", "capacity_tokens", "n_items", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least")
    )
