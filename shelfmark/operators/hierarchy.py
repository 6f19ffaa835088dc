"""Parent-child links to full hierarchies: bottom-up leaf peeling, then reverse assignment.

Each round peels nodes without remaining children, which send the sizes of their
subtrees to their parents. It also takes out, of every chain of nodes with one
remaining child, some that aren't next to each other, and joins their child to
their parent; so the number of rounds grows with the logarithm of the number of
nodes, even where the tree is one long chain. In reverse order of peeling, each
node takes depth, root and path from the node it hung on when it left. What is
never peeled are cycles, each shrunk to one node that is its own parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.runtime import drop_materialized, materialize, write_scratch

SOUND, CYCLE, ORPHAN, BELOW = "sound", "cycle", "orphan", "below"

#: How a node leaves in the round to come: as a leaf, out of a chain, or not.
_LEAF, _LINK, _STAYS = 0, 1, 2


def _zero() -> Column:
    return F.lit(0).cast("long")


def _no_ids() -> Column:
    return F.array().cast("array<bigint>")


def _nodes(rows: DataFrame, id_col: str, parent_col: str, name_col: str | None, tree: int = 0) -> DataFrame:
    """(tree, id, parent, segment), one row per tree and id: that with the smallest parent, then name; nulls are smallest."""
    given = rows.where(F.col(id_col).isNotNull()).select(
        F.lit(tree).alias("tree"), F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"),
        *([F.col(name_col).cast("string").alias("segment")] if name_col else []),
    )
    if name_col:
        return given.groupBy("id", "tree").agg(F.min(F.struct("parent", "segment")).alias("v")).select("tree", "id", "v.parent", "v.segment")
    # Two numbers instead of a struct: a hash aggregation without a sort.
    one = given.groupBy("id", "tree").agg(F.min("parent").alias("least"), F.count("parent").alias("given"), F.count(F.lit(1)).alias("n"))
    return one.select("tree", "id", F.when(F.col("given") == F.col("n"), F.col("least")).alias("parent"), F.lit(None).cast("string").alias("segment"))


def _joined(sep: str, *names: str) -> Column:
    """Names with ``sep`` between them; null where one is null."""
    parts: list[Column] = [F.lit(sep)] * (2 * len(names) - 1)
    parts[::2] = map(F.col, names)
    return F.concat(*parts)


def _marked(live: DataFrame) -> DataFrame:
    """``live`` with ``how`` each node leaves in the coming round, and ``open``: whether it could leave at all.

    A node with one child may leave as a link once its child knows that it is
    ``alone``. Every node has a number in each round: a link leaves where its number is
    above those of both neighbours, a leaf that is alone where it is above its
    parent's, any other leaf at once. So no two neighbours leave in the same round.
    """
    number = {c: F.xxhash64("turn", c) for c in ("id", "up", "kid")}
    leaf = F.col("kids") == 0
    link = (F.col("kids") == 1) & ~F.col("top") & (F.col("up") != F.col("id"))
    over_parent = number["id"] > number["up"]
    leaves = leaf & (F.col("top") | ~F.col("alone") | over_parent)
    how = F.when(leaves, _LEAF).when(link & F.col("told") & over_parent & (number["id"] > number["kid"]), _LINK).otherwise(_STAYS)
    return live.withColumns({"how": how, "link": link, "open": leaf | link})


def _next(marked: DataFrame, sep: str, chains: bool) -> DataFrame:
    """The nodes that stay, after all have told their neighbours what is new.

    A leaf tells its parent its size. A link tells its parent its size so far and
    which child takes its place, and its child the way to its parent. A node that has
    come to have one child tells it that it is alone.
    """
    leaf, link = F.col("how") == _LEAF, F.col("how") == _LINK
    tells = (F.col("how") == _STAYS) & F.col("link") & ~F.col("told")
    between = [F.concat("between", F.array("id")).alias("between")] if chains else []
    # A node gets at most one way, so ways needn't be aggregated; the rest are numbers, which are by hash.
    ways = marked.where(link).select("tree", F.col("kid").alias("id"), F.struct("up", "gap", "name", "alone", *between).alias("way"))
    sends = leaf | link
    told = (
        marked.where(sends | tells)
        .select(
            "tree", F.when(sends, F.col("up")).otherwise(F.col("kid")).alias("id"), F.when(leaf, 1).otherwise(0).alias("lost"), F.when(sends, F.col("below_n") + 1).otherwise(0).alias("got"),
            F.when(leaf, F.col("id")).when(link, F.col("id").bitwiseXOR(F.col("kid"))).otherwise(0).alias("swap"), (~sends).alias("now_alone"),
        )
        .groupBy("id", "tree")
        .agg(F.sum("lost").alias("lost"), F.sum("got").alias("got"), F.bit_xor("swap").alias("swap"), F.max("now_alone").alias("now_alone"))
    )
    moved = F.col("way").isNotNull()
    return _marked(
        marked.where(F.col("how") == _STAYS)
        .join(told, ["id", "tree"], "left")
        .join(ways, ["id", "tree"], "left")
        .select(
            "tree", "id", "parent", "top",
            # As a column, since a new constant would be compiled anew in every round.
            (F.col("turn") + 1).alias("turn"),
            (F.col("kids") - F.coalesce("lost", _zero())).alias("kids"),
            F.col("kid").bitwiseXOR(F.coalesce("swap", _zero())).alias("kid"),
            (F.col("below_n") + F.coalesce("got", _zero())).alias("below_n"),
            # A child that took another's place in this round hasn't heard it yet.
            (F.col("told") | tells & (F.coalesce("swap", _zero()) == 0)).alias("told"),
            (F.coalesce("way.alone", "alone") | F.coalesce("now_alone", F.lit(False))).alias("alone"),
            F.coalesce("way.up", "up").alias("up"),
            (F.col("gap") + F.coalesce("way.gap", F.lit(0))).alias("gap"),
            F.when(moved, _joined(sep, "way.name", "name")).otherwise(F.col("name")).alias("name"),
            *([F.when(moved, F.concat("way.between", "between")).otherwise(F.col("between")).alias("between")] if chains else []),
        )
    )


def _assign(layer: DataFrame, above: DataFrame, sep: str, chains: bool) -> DataFrame:
    """What nodes take over from the node they hung on, and links from their child.

    ``layer``: tree, id, parent, up, gap, name, below_n, and where there are links kid and how.
    """
    has = ["chain"] if chains else []
    up = above.select("tree", F.col("id").alias("up"), *[F.col(c).alias(f"u_{c}") for c in ("state", "depth", "level", "root", "path", *has)])
    j = layer.join(up, ["up", "tree"], "left")
    is_root, sound = F.col("parent").isNull(), F.col("u_state") == SOUND
    state = F.when(is_root, SOUND).when(F.col("u_state").isNull(), ORPHAN).when(sound, SOUND).otherwise(BELOW)
    below_n = F.col("below_n")
    if "kid" in layer.columns:
        child = above.select("tree", F.col("id").alias("kid"), F.col("state").alias("k_state"), F.col("below_n").alias("k_below"))
        link = F.col("how") == _LINK
        j = j.withColumn("kid", F.when(link, F.col("kid"))).join(child, ["kid", "tree"], "left")
        # What hangs on a cycle isn't on it; a link of a cycle is, as its child is.
        turns = F.coalesce(F.col("k_state") == CYCLE, F.lit(False))
        state = F.when(turns, CYCLE).otherwise(state)
        below_n = F.when(link, F.when(~turns, below_n + F.col("k_below") + 1)).otherwise(below_n)
    me = F.array(F.col("id"))
    return j.select(
        "tree",
        "id",
        "parent",
        below_n.alias("below_n"),
        state.alias("state"),
        F.when(is_root, F.lit(0)).when(sound, F.col("u_depth") + F.col("gap")).cast("int").alias("depth"),
        F.when(state == CYCLE, F.lit(0)).otherwise(F.coalesce(F.col("u_level") + F.col("gap"), F.lit(0))).cast("int").alias("level"),
        F.when(is_root, F.col("id")).when(sound, F.col("u_root")).alias("root"),
        F.when(is_root, F.col("name")).when(sound, _joined(sep, "u_path", "name")).alias("path"),
        *([F.when(state != CYCLE, F.concat(F.coalesce("u_chain", _no_ids()), "between", me)).alias("chain")] if chains else []),
    )


def _inner_nodes(nodes: DataFrame, sep: str, chains: bool) -> tuple[DataFrame, DataFrame]:
    """The nodes that have children, assigned; and (tree, id) of parents that are no nodes."""
    counted = nodes.where("parent is not null").groupBy(F.col("parent").alias("named"), "tree").agg(F.count(F.lit(1)).alias("below_n"))
    known = nodes.withColumn("named", F.col("id"))
    parents = materialize(counted.join(known, ["named", "tree"], "left"), "parents")
    missing = parents.where("id is null").select("tree", F.col("named").alias("id"))
    inner = parents.where("id is not null").drop("named")
    kids = inner.where("parent is not null").groupBy(F.col("parent").alias("id"), "tree").agg(F.count(F.lit(1)).alias("kids"), F.bit_xor("id").alias("kid"))
    lost = missing.select("tree", F.col("id").alias("parent"), F.lit(True).alias("lost"))
    live = _marked(
        inner.join(kids, ["id", "tree"], "left").join(lost, ["parent", "tree"], "left").select(
            "tree", "id", "parent", (F.col("parent").isNull() | F.col("lost").isNotNull()).alias("top"), F.lit(0).alias("turn"), F.lit(False).alias("told"), F.lit(False).alias("alone"),
            F.coalesce("kids", _zero()).alias("kids"), F.coalesce("kid", _zero()).alias("kid"),
            # Children without children of their own are counted from the start.
            (F.col("below_n") - F.coalesce("kids", _zero())).alias("below_n"),
            F.col("parent").alias("up"), F.lit(1).alias("gap"), F.col("segment").alias("name"), *([_no_ids().alias("between")] if chains else []),
        )
    )
    rounds: list[DataFrame] = []
    while True:
        seen = Observation()
        rounds.append(materialize(live.observe(seen, F.count_if("open").alias("open")), f"peeled-{len(rounds)}"))
        if not seen.get["open"]:
            break
        live = _next(rounds[-1], sep, chains)
    null = F.lit(None)
    above = rounds[-1].select(
        "tree", "id", "parent", null.cast("long").alias("below_n"), F.lit(CYCLE).alias("state"), null.cast("int").alias("depth"), F.lit(0).alias("level"), null.cast("long").alias("root"),
        null.cast("string").alias("path"), *([null.cast("array<bigint>").alias("chain")] if chains else []),
    )
    written = [write_scratch(above, "cycles")]
    reader = above.sparkSession.read.schema(above.schema)
    for turn, marked in reversed(list(enumerate(rounds[:-1]))):
        layer = _assign(marked.where(F.col("how") != _STAYS), reader.parquet(*written), sep, chains)
        written.append(write_scratch(layer, f"assigned-{turn}"))
    drop_materialized(*rounds)
    return reader.parquet(*written), missing


def _with_leaves(nodes: DataFrame, inner: DataFrame, sep: str, chains: bool) -> DataFrame:
    leaves = nodes.join(inner.select("tree", "id"), ["id", "tree"], "left_anti").select(
        "tree", "id", "parent", F.col("parent").alias("up"), F.lit(1).alias("gap"), F.col("segment").alias("name"), _zero().alias("below_n"), *([_no_ids().alias("between")] if chains else []),
    )
    return inner.unionByName(_assign(leaves, inner, sep, chains))


def _broken(nodes: DataFrame, inner: DataFrame, missing: DataFrame) -> DataFrame:
    """(tree, id, state) of the nodes that aren't sound.

    Nodes without children are only held against the parents that are missing or
    not sound, which are few where most links are sound.
    """
    bad = materialize(inner.where(F.col("state") != SOUND).select("tree", "id", "state"), "broken")
    parents = bad.select("tree", F.col("id").alias("parent"), F.lit(BELOW).alias("state")).unionByName(missing.select("tree", F.col("id").alias("parent"), F.lit(ORPHAN).alias("state")))
    leaves = nodes.join(parents, ["parent", "tree"]).join(bad.select("tree", "id"), ["id", "tree"], "left_anti")
    return bad.unionByName(leaves.select("tree", "id", "state"))


def build_hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str | None = None, sep: str = "/", chains: bool = False) -> DataFrame:
    """One row per node: id, parent, below_n, state, depth, level, root, path (and chain).

    ``below_n`` is the number of a node's descendants (null on a cycle); ``state``
    is 'sound', 'cycle' (on a circle of parents, also of itself), 'orphan' (its
    parent doesn't exist) or 'below' (the chain of parents reaches such a node).
    Sound nodes have depth (0 for roots), root, path (``name_col`` joined from the
    root; null if a name on the way is null). ``level`` is the distance from the
    root, orphan or cycle above; with ``chains``, ``chain`` has the ids from there (a
    cycle's not) to the node, and is null on a cycle. The list of a node's descendants
    is not kept in one row, where a root's could hold most of the table:
    :func:`descendants` gives it as rows.

    A null parent makes a root; a row with a null id is no node and is left out;
    rows with the same id are one node with the smallest (parent, name). Other
    columns, whatever their names, don't matter. No rows give no rows.
    """
    nodes = materialize(_nodes(rows, id_col, parent_col, name_col), "nodes")
    inner, _ = _inner_nodes(nodes, sep, chains)
    return _with_leaves(nodes, inner, sep, chains).drop("tree")


def broken_links(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, state) of the nodes of :func:`build_hierarchy` that aren't sound."""
    nodes = materialize(_nodes(rows, id_col, parent_col, None), "nodes")
    return _broken(nodes, *_inner_nodes(nodes, "/", False)).drop("tree")


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all sound nodes, a row for each pair; needs ``chain``."""
    return (
        hierarchy.where("state = 'sound' and depth > 0")
        .select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("chain", 1, F.col("depth"))).alias("at", "ancestor"))
        .select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    )


def link_defects(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, node_id, defect) of the links of ``paths`` and ``entries_core``.

    'cycle', 'orphan' and 'below' as in :func:`build_hierarchy`; 'stale_path' for
    sound paths whose full_path isn't null and differs from the names of the chain.
    """
    # Both tables' trees are peeled together.
    sources = ("paths", "entries_core")
    names = materialize(_nodes(paths, "id", "parent_id", "segment", 0), "names")
    links = materialize(_nodes(entries, "id", "parent_id", None, 1), "links")
    inner, missing = _inner_nodes(names.unionByName(links), "/", False)
    tree = materialize(_with_leaves(names, inner.where("tree = 0"), "/", False).select("tree", "id", "state", "path"), "path-tree")
    stored = paths.where("id is not null and full_path is not null").select("id", "full_path")
    stale = tree.where("state = 'sound' and path is not null").join(stored, "id").where("path <> full_path").select("tree", "id", F.lit("stale_path").alias("state")).distinct()
    broken = _broken(links, *[df.where("tree = 1") for df in (inner, missing)])
    defects = tree.where(F.col("state") != SOUND).select("tree", "id", "state").unionByName(stale).unionByName(broken)
    return defects.select(F.when(F.col("tree") == 0, sources[0]).otherwise(sources[1]).alias("src"), F.col("id").alias("node_id"), F.col("state").alias("defect"))
