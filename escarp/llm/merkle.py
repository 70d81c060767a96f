"""A Merkle manifest of a dataset, and a recursive query that proves each row against its root.

Every row is a leaf. The leaves of a group (a source) form a tree with runs of `FAN` nodes, the roots
of the groups form one more. Built levels are stored as parent-linked node rows: a node, its parent,
and the digests left and right of it in its run. A recursive query climbs from the leaves: each step
joins a node to its row, appends the siblings to the proof and folds the leaf's digest with them.

The leaves of one run have all nodes above them in common, so they climb together, as one row that
folds each leaf's own digest. Near the root many rows meet at few nodes; these are stored once for
each lane (`LANE` runs of a group), so no key of the join has more than `LANE` rows.

Leaf positions come from a range sort and the number of rows before each partition, never from a
window over a group. A group that holds a third of all rows is spread like all others.

Defined results: a NULL field is `-`, so NULL and an empty text differ. A NULL group is a group of its
own, before all others. A NULL id sorts first and counts as the empty text where rows to tamper with
are chosen. Rows with equal ids are ordered by their leaf; equal rows are leaves of their own. An empty table
gives no rows. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escarp.llm.exact_dedup import _setting
from escarp.llm.texts import lower_ascii, remainder
from escarp.session import materialize, scratch_dir

FAN = 16
#: Runs of a group that climb over one copy of a node.
LANE = 4096

_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

_CLIMB = """
WITH RECURSIVE climb (grp, lane, run, tree, level, pos, folded, proof) AS (
  SELECT grp, lane, run, tree, level, pos, folded, proof FROM {feet}
  UNION ALL
  SELECT c.grp, c.lane, c.run, n.up_tree, n.up_level, n.up_pos,
         transform(c.folded, f -> sha2(concat(n.left_of, f, n.right_of), 256)),
         concat(c.proof, unhex(n.left_of), unhex(n.right_of))
  FROM climb c JOIN {nodes} n
    ON c.grp = n.grp AND c.lane = n.lane AND c.tree = n.tree AND c.level = n.level AND c.pos = n.pos
)
SELECT grp, lane, run, folded, proof FROM climb WHERE tree = '' AND level = {top}
"""


def digest_of(fields: Sequence[Column]) -> Column:
    """Digest of a row: byte length and value of each field, NULL as `-`."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        size = F.octet_length(text).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))

    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def _positioned(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Rows with `pos`, their place within `tree`, and `n`, the rows of that tree."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), path)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    spans = placed.groupBy("tree", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part")) - F.col("size")
    spans = spans.select(
        "tree", "part", (before - F.col("low")).alias("shift"), F.sum("size").over(tree).alias("n")
    )
    joined = placed.join(spans, ["tree", "part"])
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _width(level: int) -> Column:
    """Nodes of a tree at a level."""
    return F.ceil(F.col("n") / F.lit(FAN**level))


def _runs(nodes: DataFrame, level: int, *extra: str) -> DataFrame:
    """Runs of a level: (tree, n, run, kids, digest); a lone node's digest stays as it is."""
    runs = nodes.groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("run"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *extra))).alias("kids"))
    joined = F.array_join(F.col("kids.digest"), "").cast("binary")
    lone = F.when(_width(level) == 1, F.col("kids")[0]["digest"])
    return runs.withColumn("digest", lone.otherwise(F.sha2(joined, 256)))


def _levels(runs: DataFrame, scratch: str, name: str) -> list[DataFrame]:
    """The runs of every level of all trees, each written once, from the leaves to the roots."""
    levels = []
    while True:
        runs = materialize(runs, f"{scratch}/{name}{len(levels)}")
        levels.append(runs)
        above = runs.filter(_width(len(levels)) > 1)
        if above.isEmpty():
            return levels
        runs = _runs(above.select("tree", "n", F.col("run").alias("pos"), "digest"), len(levels))


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, n, digest, height): the root of each tree and the level it is on."""
    lone = levels[0].filter(F.col("n") == 1).select("tree", "n", "digest", F.lit(0).alias("height"))
    for level, runs in enumerate(levels):
        last = runs.filter((_width(level) > 1) & (_width(level + 1) == 1))
        lone = lone.unionByName(last.select("tree", "n", "digest", F.lit(level + 1).alias("height")))
    return lone


def _steps(level: int, runs: DataFrame) -> DataFrame:
    """Parent-linked rows of the nodes of a level: (tree, n, level, pos, up_pos, left_of, right_of)."""
    apart = runs.filter(_width(level) > 1).select("tree", "n", "run", "kids", F.posexplode("kids").alias("i", "kid"))
    return apart.select(
        "tree",
        "n",
        F.lit(level).alias("level"),
        F.col("kid.pos").alias("pos"),
        F.col("run").alias("up_pos"),
        F.expr("array_join(slice(kids.digest, 1, i), '')").alias("left_of"),
        F.expr("array_join(slice(kids.digest, i + 2, size(kids)), '')").alias("right_of"),
    )


def _in_lanes(steps: DataFrame, level: int, groups: DataFrame) -> DataFrame:
    """Rows of nodes below the group roots, one for each lane of their group that passes."""
    span = FAN ** (level - 1)
    first = F.expr(f"(pos * {span}L) div {LANE}")
    last = F.expr(f"(least((pos + 1) * {span}L, ceil(n / {FAN})) - 1) div {LANE}")
    at_root = F.col("level") + 1 == F.col("height")
    laned = steps.withColumn("lane", F.explode(F.sequence(first, last)))
    return laned.join(groups.select("tree", "lane", "rank", "height"), ["tree", "lane"]).select(
        F.col("tree").alias("grp"),
        "lane",
        "tree",
        "level",
        "pos",
        F.when(at_root, F.lit("")).otherwise(F.col("tree")).alias("up_tree"),
        F.when(at_root, F.lit(0)).otherwise(F.col("level") + 1).alias("up_level"),
        F.when(at_root, F.col("rank")).otherwise(F.col("up_pos")).alias("up_pos"),
        "left_of",
        "right_of",
    )


def _above_groups(steps: DataFrame, level: int, groups: DataFrame) -> DataFrame:
    """Rows of nodes from the group roots up, one for each lane below them."""
    lanes = groups.select(F.col("tree").alias("grp"), "lane", F.expr(f"rank div {FAN**level}L").alias("pos"))
    return steps.join(lanes, "pos").select(
        "grp",
        "lane",
        F.lit("").alias("tree"),
        "level",
        "pos",
        F.lit("").alias("up_tree"),
        (F.col("level") + 1).alias("up_level"),
        "up_pos",
        "left_of",
        "right_of",
    )


def _feet(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Where the climb starts: the runs of the leaves, each leaf folded with its run."""
    tampered = "coalesce(x.changed, x.digest)"
    fold = f"sha2(array_join(transform(kids, y -> if(y.pos = x.pos, {tampered}, y.digest)), ''), 256)"
    arrived = F.col("height") <= 1
    runs = runs.withColumn("lane", F.expr(f"run div {LANE}"))
    return runs.join(groups.select("tree", "lane", "rank", "height"), ["tree", "lane"]).select(
        F.col("tree").alias("grp"),
        "lane",
        "run",
        F.when(arrived, F.lit("")).otherwise(F.col("tree")).alias("tree"),
        F.when(arrived, F.lit(0)).otherwise(F.lit(1)).alias("level"),
        F.when(arrived, F.col("rank")).otherwise(F.col("run")).alias("pos"),
        F.expr(f"transform(kids, x -> if(height = 0, {tampered}, {fold}))").alias("folded"),
        F.lit(b"").alias("proof"),
    )


def proofs(
    docs: DataFrame, fields: Sequence[str], id_col: str, group_col: str, tampered: dict[str, Column]
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `fields` are the columns of a leaf in order; `tampered` has other values for some of them, with
    which the row is folded into the stored tree in place of its own.
    """
    spark = docs.sparkSession
    scratch = scratch_dir(spark)
    columns = {c: F.col(f"`{c}`") for c in fields}
    touched = F.lit(False)
    for c, value in tampered.items():
        touched |= ~columns[c].eqNullSafe(value)
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group)).alias("tree"),
        F.col(f"`{id_col}`").alias("id"),
        digest_of(list(columns.values())).alias("digest"),
        F.when(touched, digest_of(list((columns | tampered).values()))).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # the texts are read once; all that follows works on digests
    leaves = materialize(leaves, f"{scratch}/leaves")
    placed = _positioned(leaves, ["id", "digest", "tie"], f"{scratch}/ordered")
    levels = _levels(_runs(placed, 0, "id", "changed"), scratch, "level")
    roots = _roots(levels).withColumnRenamed("tree", "name")
    tops = roots.withColumnRenamed("n", "leaves").withColumn("tree", F.lit(""))
    tops = materialize(_positioned(tops, ["name"], f"{scratch}/groups"), f"{scratch}/ranked")
    above = _levels(_runs(tops, 0), scratch, "above")
    ends = _roots(above).select("digest", "height").first()
    root, top = ends or ("", 0)

    lanes = F.sequence(F.lit(0).cast("long"), F.expr(f"(ceil(leaves / {FAN}) - 1) div {LANE}"))
    groups = tops.select(
        F.col("name").alias("tree"),
        F.explode(lanes).alias("lane"),
        F.col("pos").alias("rank"),
        "height",
        F.col("digest").alias("subroot"),
    )
    groups = materialize(groups, f"{scratch}/lanes")
    nodes = _above_groups(_steps(0, above[0]), 0, groups)
    for level, runs in enumerate(above[1:], 1):
        nodes = nodes.unionByName(_above_groups(_steps(level, runs), level, groups))
    for level, runs in enumerate(levels[1:], 1):
        nodes = nodes.unionByName(_in_lanes(_steps(level, runs), level, groups))
    nodes = materialize(nodes, f"{scratch}/nodes")
    feet = materialize(_feet(levels[0], groups), f"{scratch}/feet")
    with _setting(spark, _ROW_LIMIT, "-1"):
        climbed = materialize(spark.sql(_CLIMB, feet=feet, nodes=nodes, top=top), f"{scratch}/climbed")

    beside = "array_join(transform(filter(kids, y -> y.pos <> x.pos), y -> y.digest), '')"
    rows = levels[0].select(
        F.col("tree").alias("grp"),
        "run",
        F.expr(f"transform(kids, x -> struct(x.id, x.digest AS leaf, {beside} AS beside))").alias("kids"),
    )
    named = groups.select(F.col("tree").alias("grp"), "lane", "subroot")
    joined = rows.join(climbed, ["grp", "run"]).join(named, ["grp", "lane"])
    each = joined.select("subroot", "proof", F.explode(F.arrays_zip("kids", "folded")).alias("leaf"))
    proof = F.concat(F.col("leaf.kids.beside"), F.lower(F.hex("proof")))
    return each.select(
        F.col("leaf.kids.id").alias("id"),
        F.col("leaf.kids.leaf").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        F.col("leaf.folded").alias("folded_root"),
        (F.col("leaf.folded") == F.lit(root)).alias("verified"),
    )


def lowered_in_every_fifth(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, with A-Z lower-cased in rows the crc32 of whose id is divisible by 5."""
    text = F.col(f"`{text_col}`").cast("string")
    chosen = (remainder(F.col(f"`{id_col}`"), 5) == 0) & text.isNotNull()
    return F.when(chosen, lower_ascii(text)).otherwise(text)


def comparison_sql(levels: int = 5, group_levels: int = 2) -> str:
    """SQL for `documents` whose groups have at most FAN ** levels rows; ids are unique."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        names = ("doc_id", "source", "lang", "n_chars", text)
        fields = (f"CAST({c} AS VARCHAR)" for c in names)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def run(name: str, level: int, key: str) -> str:
        return (
            f"{name}{level + 1} AS (SELECT {key} pos // {FAN} AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) "
            f"ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, CAST(ceil(any_value(n) / {FAN}) AS BIGINT) AS n "
            f"FROM {name}{level} GROUP BY {key} pos // {FAN})"
        )

    def step(at: int, name: str, level: int, same: str) -> str:
        beside = "coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), '')"
        folded = "sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.x ELSE t.h END, '' ORDER BY t.pos))"
        return (
            f"c{at + 1} AS (SELECT c.doc_id, c.source, c.leaf, c.pos // {FAN} AS pos, "
            f"c.proof || CASE WHEN any_value(t.n) = 1 THEN '' ELSE {beside} END AS proof, "
            f"CASE WHEN any_value(t.n) = 1 THEN c.x ELSE {folded} END AS x FROM c{at} c JOIN {name}{level} t "
            f"ON {same} t.pos // {FAN} = c.pos // {FAN} GROUP BY c.doc_id, c.source, c.leaf, c.pos, c.proof, c.x)"
        )

    # crc32: a table of 256 remainders, then a fold over the digits of the id
    parts = ["r0 AS (SELECT i, i AS x FROM range(256) t(i))"]
    parts += [f"r{k + 1} AS (SELECT i, xor(x >> 1, 3988292384 * (x & 1)) AS x FROM r{k})" for k in range(8)]
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    fold = "lambda a, b: xor(a >> 8, r[CAST(xor(a, b) & 255 AS INT) + 1])"
    parts += [
        "rs AS (SELECT list(x ORDER BY i) AS r FROM r8)",
        f"d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, {digits}), {fold})) AS crc FROM documents, rs)",
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS bad, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "s0 AS (SELECT source, pos, leaf AS h, n FROM l)",
    ]
    parts += [run("s", k, "source,") for k in range(levels)]
    parts.append(
        "g0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, "
        f"count(*) OVER () AS n FROM s{levels})"
    )
    parts += [run("g", k, "") for k in range(group_levels)]
    parts.append("c0 AS (SELECT doc_id, source, leaf, pos, '' AS proof, bad AS x FROM l)")
    parts += [step(k, "s", k, "t.source IS NOT DISTINCT FROM c.source AND") for k in range(levels)]
    parts.append(
        f"c{levels + 1} AS (SELECT c.doc_id, c.source, c.leaf, g.pos, c.proof, c.x "
        f"FROM c{levels} c JOIN g0 g ON g.source IS NOT DISTINCT FROM c.source)"
    )
    parts += [step(levels + 1 + k, "g", k, "") for k in range(group_levels)]
    return (
        f"WITH {', '.join(parts)} SELECT c.doc_id, c.leaf, g.h AS subroot, e.h AS root, sha256(c.proof) AS proof_sha256, "
        f"c.x AS folded_root, c.x = e.h AS verified FROM c{levels + 1 + group_levels} c "
        f"JOIN g0 g ON g.source IS NOT DISTINCT FROM c.source, g{group_levels} e"
    )
