"""Mixing sources to target weights, in blocks of tokens.

1. Pack: the words of each source are one long sequence, cut into blocks of `block_words`; a
   document is a range of that sequence, so a block is a list of (document, words) segments.
2. Draw: the mix has a fixed number of slots. Each output shard draws from a multinomial over the
   sources: every slot of the shard draws a number below the total of all quotas, and the source
   in whose interval it falls gets a slot. What a source has drawn above its quota over all shards
   goes, slot by slot, to the sources that are short, so that totals meet the targets.
3. Permute: the r-th slot of a source is pass r div n of its n blocks, and the block there is a
   keyed swap-or-not permutation of r mod n: every block once per pass, in pseudo-random order.
4. Join blocks by index.

All is built-in functions, and every number comes from hashes with a seed: reruns agree. Running
sums are two-level: inside buckets of about `BUCKET_ROWS` documents, then over buckets, so a source
with a third of all rows has no task of its own.

Defined results: a NULL or empty text has size 0 and is never taken; a NULL source is a source of
its own, last in order; equal ids and repeated rows each keep their row; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escarp.llm.texts import WORD
from escarp.session import materialize, scratch_dir

BUCKET_ROWS = 128
ROUNDS = 24
TASK_SLOTS = 1 << 15
CELLS = 1024
COPIES = 1024


class Mix(NamedTuple):
    """Tables of a mix.

    targets: sid, source, source_size, target, blocks, quota. documents: doc columns, sid, bucket,
    place, first (where the document's words begin in its source). slots: shard, sid, pass, block.
    counts: shard, sid, slots.
    """

    targets: DataFrame
    documents: DataFrame
    slots: DataFrame
    counts: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Target of each source: (sid, source, source_size, target), from (source, size) rows.

    Weights repeat over the sources in code point order, NULL last. A source is full when its cap is
    at most its weighted share of what the fuller ones leave; sorted by cap / weight, the full ones
    come first. One row per source meets in one task, never a document.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = totals.withColumn("sid", F.row_number().over(ordered) - 1).withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1),
    )
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    most = cap * F.col("source_size")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        named.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("used", F.coalesce(F.sum(most).over(before), F.lit(0.0)))
        .withColumn(
            "left_weight",
            F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)),
        )
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("left_weight"))
        .withColumn("full", most <= F.col("level") * F.col("weight"))
    )
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "sid", "level"))).over(everything)
    return levels.withColumn("open", open_level["level"]).select(
        "sid",
        "source",
        "source_size",
        F.when(F.col("full"), most).otherwise(F.col("open") * F.col("weight")).alias("target"),
    )


def _unit(*parts: Column) -> Column:
    """A pseudo-random integer of 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def permuted(index: str, size: str, key: list[str], rounds: int = ROUNDS) -> Column:
    """Swap-or-not: a keyed permutation of 0 .. size - 1 for any size.

    In each round x and its mirror k - x (mod size) are swapped or not, by one bit that depends on
    the larger of the two, so a round is a bijection.
    """
    keys = ", ".join(key)
    mirror = f"pmod(shiftrightunsigned(xxhash64('k', i, {keys}), 2) % {size} - x, {size})"
    return F.expr(
        f"""
        aggregate(sequence(1, {rounds}), CAST({index} AS BIGINT), (x, i) ->
            IF(xxhash64('s', i, {keys}, greatest(x, {mirror})) >= 0, x, {mirror}))
        """
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 7,
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Pack, draw and permute. `share` is the size of the mix against all words, `cap` the most
    passes over a source (whole passes are what blocks can give: cap is rounded down)."""
    scratch = scratch_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [c for c in docs.columns if c not in (text_col, source_col)]
    sized = docs.select(
        F.struct(*([F.col(f"`{c}`") for c in carried] or [F.lit(0)])).alias("row"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )
    sized = materialize(sized, f"{scratch}/sized")
    rows = sized.count()
    plan = targets(sized.select("source", "size"), weights, share, cap)
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    quota = F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long")
    quota = F.when(F.col("source_size") == 0, 0).otherwise(F.least(quota, F.col("blocks") * int(cap)))
    plan = materialize(plan.withColumn("quota", quota.cast("long")), f"{scratch}/targets")

    documents = _packed(sized, plan, max(1, rows // BUCKET_ROWS), scratch)
    counts = materialize(_counts(plan, shard_slots, seed, scratch), f"{scratch}/counts")
    total = counts.agg(F.sum("slots")).first()[0] or 0
    slots = _slots(counts, plan, seed, total // TASK_SLOTS + 1)
    return Mix(plan, documents, materialize(slots, f"{scratch}/slots"), counts)


def _numbered(sized: DataFrame) -> DataFrame:
    """The rows with `copy`, the number of the row among equal ones.

    Equal rows are counted and dealt out anew in runs of COPIES, so they need no order among them, and
    a row that a third of the table repeats is spread like any other.
    """
    columns = ["row", "source", "size", "text_hash"]
    counted = sized.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    runs = counted.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    numbers = F.expr(f"sequence(run * {COPIES}, least(n, (run + 1) * {COPIES}) - 1)")
    return runs.withColumn("copy", F.explode(numbers)).select(*columns, "copy")


def _packed(sized: DataFrame, plan: DataFrame, buckets: int, scratch: str) -> DataFrame:
    """The documents with the place of their first word in their source."""
    sized = _numbered(sized)
    named = sized.join(plan.select("sid", "source"), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    bucketed = named.withColumn("order", F.xxhash64("row", "text_hash", "copy")).withColumn(
        "bucket", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(buckets))
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("order", "text_hash")
    local = materialize(
        bucketed.withColumn("place", F.row_number().over(inside)).withColumn(
            "before",
            F.coalesce(
                F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        ),
        f"{scratch}/local",
    )
    totals = local.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    return local.join(bases, ["sid", "bucket"]).select(
        "row", "text_hash", "source", "size", "sid", "bucket", "place",
        (F.col("base") + F.col("before")).alias("first"),
    )


def _counts(plan: DataFrame, shard_slots: int, seed: int, scratch: str) -> DataFrame:
    """Slots of each source in each shard: multinomial draws, evened out to the quotas."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("quota")).first()[0] or 0
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    bounds = plan.filter("quota > 0").select(
        "sid", "quota", F.coalesce(F.sum("quota").over(running), F.lit(0)).alias("low")
    )
    # intervals of sources meet draws by equal cells of the drawn range
    width = max(1, -(-total // CELLS))
    cells = bounds.withColumn(
        "cell", F.explode(F.expr(f"sequence(low div {width}, (low + quota - 1) div {width})"))
    )
    draws = spark.range(total).select(
        (F.col("id") / shard_slots).cast("long").alias("shard"),
        (_unit(F.lit(seed), F.lit("draw"), F.col("id")) % max(total, 1)).alias("drawn"),
    )
    drawn = (
        draws.withColumn("cell", F.expr(f"drawn div {width}"))
        .join(cells, "cell")
        .filter("drawn >= low AND drawn < low + quota")
        .groupBy("shard", "sid")
        .agg(F.count(F.lit(1)).alias("slots"))
    )
    drawn = materialize(drawn, f"{scratch}/drawn")
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        drawn.withColumn("offset", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
        .join(bounds.select("sid", "quota"), "sid")
        .withColumn("kept", F.greatest(F.lit(0), F.least("slots", F.col("quota") - F.col("offset"))))
    )
    shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    freed = (
        kept.groupBy("shard")
        .agg(F.sum(F.col("slots") - F.col("kept")).alias("n"))
        .withColumn("low", F.coalesce(F.sum("n").over(shards), F.lit(0)))
        .filter("n > 0")
        .select("shard", F.explode(F.expr("sequence(low, low + n - 1)")).alias("k"))
    )
    short = (
        bounds.join(drawn.groupBy("sid").agg(F.sum("slots").alias("got")), "sid", "left")
        .withColumn("n", F.greatest(F.lit(0), F.col("quota") - F.coalesce("got", F.lit(0))))
        .withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .filter("n > 0")
        .select("sid", F.explode(F.expr("sequence(start, start + n - 1)")).alias("k"))
    )
    moved = freed.join(short, "k").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("kept"))
    return (
        kept.select("shard", "sid", "kept")
        .unionByName(moved)
        .groupBy("shard", "sid")
        .agg(F.sum("kept").alias("slots"))
        .filter("slots > 0")
    )


def _slots(counts: DataFrame, plan: DataFrame, seed: int, tasks: int) -> DataFrame:
    """One row per slot: shard, sid, pass and block."""
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        counts.withColumn("offset", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
        .join(plan.select("sid", "blocks"), "sid")
        .repartition(tasks, "shard", "sid")
        .withColumn("rank", F.explode(F.expr("sequence(offset, offset + slots - 1)")))
        .withColumn("pass", F.expr("rank div blocks"))
        .withColumn("index", F.expr("rank % blocks"))
    )
    block = permuted("index", "blocks", [f"{seed}L", "sid", "pass"])
    return ranked.select("shard", "sid", "pass", block.alias("block"))


def segments(documents: DataFrame, block_words: int = 64) -> DataFrame:
    """Documents cut at block borders: block and `words` of the document in it, `from` its first.

    A document without words has one row with NULL block and 0 words.
    """
    blocks = F.expr(
        f"IF(size > 0, sequence(first div {block_words}, (first + size - 1) div {block_words}), NULL)"
    )
    cut = documents.withColumn("block", F.explode_outer(blocks))
    begin = F.greatest("first", F.col("block") * block_words)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.withColumn("from", begin - F.col("first")).withColumn(
        "words", F.coalesce(end - begin, F.lit(0))
    )


def taken(mixed: Mix, block_words: int = 64) -> DataFrame:
    """Per document the words that the mix takes, repeats counted: the blocks joined by index."""
    uses = mixed.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    used = segments(mixed.documents, block_words).join(uses, ["sid", "block"], "left")
    words = F.sum(F.col("words") * F.coalesce("uses", F.lit(0)))
    return (
        used.groupBy("sid", "bucket", "place")
        .agg(F.first("row").alias("row"), F.first("size").alias("size"), words.alias("taken"))
        .join(mixed.targets.select("sid", "source", "source_size", "target"), "sid")
    )


def mixed_documents(docs: DataFrame, block_words: int = 64, **options) -> DataFrame:
    """The documents of the mix: per document and pass one row with the words taken in that pass.

    A document taken whole keeps its text as it is; of one taken in part the taken words remain,
    joined by single blanks. Documents without words are no part of a mix.
    """
    mixed = mix(docs, block_words=block_words, **options)
    used = segments(mixed.documents, block_words).join(mixed.slots, ["sid", "block"])
    parts = used.groupBy("text_hash", "row", "source", "sid", "bucket", "place", "pass").agg(
        F.sum("words").alias("got"),
        F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("from", "words"))).alias("ranges"),
    )
    # repeated rows have one content: their parts meet one copy of it
    carried = [c for c in docs.columns if c not in ("text", "source")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = docs.select(
        F.struct(*([F.col(f"`{c}`") for c in carried] or [F.lit(0)])).alias("row"),
        F.xxhash64(text).alias("text_hash"),
        F.col("text"),
    ).dropDuplicates(["row", "text_hash"])
    words = F.expr(f"regexp_extract_all(text, '{WORD}', 0)".replace("\\", "\\\\"))
    some = F.expr(
        "array_join(flatten(transform(ranges, r -> slice(all_words, CAST(r.from AS INT) + 1, CAST(r.words AS INT)))), ' ')"
    )
    whole = F.col("got") == F.col("size")
    joined = (
        parts.join(content, ["row", "text_hash"])
        .withColumn("all_words", F.when(~whole, words))
        .withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    )
    columns = []
    for name in docs.columns:
        if name == "n_chars":
            columns.append(F.length("text").cast(docs.schema[name].dataType).alias(name))
        elif name in ("text", "source"):
            columns.append(F.col(name))
        else:
            columns.append(F.col("row")[name].alias(name))
    return joined.select(*columns)
