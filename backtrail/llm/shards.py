"""Shards of equal size by balanced label propagation.

Documents with equal texts are linked. Each starts in a shard by hash; then, round by
round, the documents of a group move to the shard where most of the group is, as far
as that shard has room. Rows of one group in one shard always move alike, so the
rounds work on counts per group and shard. What no longer fits, and all that has no
link, fills the shards to exactly even counts.

Groups larger than an eighth of a shard are cut into parts by hash first: no shard
could hold the largest, and no task has to. Parts move one by one, but look at where
their neighbours are, the parts that could fill a shard together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtrail.llm.common import with_place
from backtrail.session import cut_lineage

#: Parts of a shard that a group may fill before it is cut, and parts that seek a shard together.
_PARTS, _TOGETHER = 8, 7
#: Buckets of groups in which moves into a shard are admitted or refused together.
_GATES = 1024
_NODE = ["h", "crc", "size", "part"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``size``, ``crc``, ``h`` (hash of the text) and ``r``, a hash that tells repeated rows apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"),
        F.xxhash64(id_col, F.monotonically_increasing_id()).alias("r"))


def _in_parts(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Add ``part``: 0, or for a large group one of as many as keep each under an eighth of a shard."""
    most = max(total // (shards * _PARTS), 1)
    large = rows.groupBy("h", "crc", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(
        "h", "crc", "size", F.ceil(F.col("n") / most).alias("parts"))
    split = rows.join(F.broadcast(large), ["h", "crc", "size"], "left")  # at most 2 * shards * _PARTS rows
    return split.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("r", "parts")).cast("int")).drop("parts")


def _gate() -> Column:
    return F.pmod(F.xxhash64(*_NODE), F.lit(_GATES))


def _round(state: DataFrame, room: dict[int, int]) -> DataFrame:
    """One round: every group asks to move to the shard where most of it is; quotas decide.

    A shard takes what it has room for, counting the rows that ask to leave it, in the
    order of the gates. A shard that has no room for the rest of a group is asked only
    if no other is known to the group.
    """
    near = ["h", "crc", "size", "side"]
    free = F.create_map(*[F.lit(x) for pair in sorted(room.items()) for x in pair])
    asked = state.withColumn("side", F.floor(F.col("part") / _TOGETHER)).withColumns({
        "weight": F.sum("n").over(Window.partitionBy(*near, "cur")),
        "here": F.sum("n").over(Window.partitionBy(*_NODE, "cur")),
        "all": F.sum("n").over(Window.partitionBy(*_NODE))})
    fits = (F.element_at(free, F.col("cur")) >= F.col("all") - F.col("here")).cast("int")
    wish = F.struct(fits.alias("fits"), "weight", F.xxhash64(*near, "cur").alias("tie"), "cur")
    asked = asked.withColumn("target", F.max(wish).over(Window.partitionBy(*_NODE))["cur"]).withColumn("gate", _gate())
    asked = cut_lineage(asked.select(*_NODE, "start", "cur", "n", "target", "gate"))
    moves = asked.where("cur <> target")
    leaving = moves.groupBy(F.col("cur").alias("target")).agg(F.sum("n").alias("out"))
    demand = moves.groupBy("target", "gate").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("target").orderBy("gate"))
    passed = demand.withColumn("running", running).join(leaving, "target", "left").where(
        F.col("running") <= F.element_at(free, F.col("target")) + F.coalesce("out", F.lit(0))).select(
        "target", "gate", F.lit(True).alias("passed"))
    told = asked.join(F.broadcast(passed), ["target", "gate"], "left")  # at most shards * _GATES rows
    return told.select(*_NODE, "start", F.when(F.col("passed"), F.col("target")).otherwise(F.col("cur")).alias("cur"), "n")


def propagate(rows: DataFrame, quota: dict[int, int], rounds: int = 6) -> DataFrame:
    """``_NODE``, ``start`` and ``cur``: where the rows of each group that began in ``start`` end.

    Only groups of two or more rows take part.
    """
    counts = rows.groupBy(*_NODE, "start").agg(F.count(F.lit(1)).alias("n"))
    linked = counts.withColumn("all", F.sum("n").over(Window.partitionBy(*_NODE))).where("all > 1").drop("all")
    state = cut_lineage(linked.select(*_NODE, "start", F.col("start").alias("cur"), "n"))
    for _ in range(rounds):
        load = {r["cur"]: r["n"] for r in state.groupBy("cur").agg(F.sum("n").alias("n")).collect()}
        before = state
        state = cut_lineage(_round(before, {s: q - load.get(s, 0) for s, q in quota.items()}))
        keys = [*_NODE, "start"]
        if not state.join(before.select(*keys, F.col("cur").alias("was")), keys).where("cur <> was").limit(1).count():
            break
    return state


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into a shard; counts of two shards differ by at most one.

    Links join documents with equal texts; null and empty texts are equal. Returns the
    id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law`` (``rows``),
    ``shard`` (from 0), ``slot`` (place in the shard, without gaps) and ``grown_shard``
    (null: this law has none). Repeated rows and rows with a null id are placed one by one.
    """
    rows = cut_lineage(_documents(docs, id_col, text_col))
    total = rows.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    rows = _in_parts(rows, total, shards).withColumn(
        "start", F.pmod(F.xxhash64("r"), F.lit(shards)).cast("int"))  # apart from the hash that cuts groups
    rows = cut_lineage(rows)
    moved = propagate(rows, quota).select(*_NODE, "start", F.col("cur").alias("shard"))
    placed = cut_lineage(rows.join(moved, [*_NODE, "start"], "left"))
    load = {r["shard"]: r["n"] for r in placed.where("shard IS NOT NULL").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(256, total // 10_000)
    by_group = F.shiftrightunsigned(F.xxhash64(*_NODE), 1)
    order = [F.xxhash64(*_NODE), F.col("r")]
    over = [s for s, n in load.items() if n > quota[s]]
    fixed = placed.where(F.col("shard").isNotNull() & ~F.col("shard").isin(over))
    loose = placed.where(F.col("shard").isNull())
    if over:  # a shard that took more than it can hold keeps its first groups
        limit = F.element_at(F.create_map(*[F.lit(x) for s in over for x in (s, quota[s])]), F.col("shard"))
        ranked = cut_lineage(with_place(placed.where(F.col("shard").isin(over)), ["shard"], order, by_group, buckets))
        fixed = fixed.unionByName(ranked.where(F.col("place") < limit).drop("place"))
        loose = loose.unionByName(ranked.where(F.col("place") >= limit).drop("place"))
    ends, at = [], 0
    for s in range(shards):
        at += quota[s] - min(load.get(s, 0), quota[s])
        ends.append(at)
    # the loose rows in one order, groups together: each shard takes the next ones up to its quota
    ranked = with_place(loose.drop("shard"), [], order, by_group, buckets)
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place"))).cast("int")
    whole = fixed.unionByName(ranked.withColumn("shard", shard).drop("place"))
    slots = with_place(whole, ["shard"], [F.col("r")], F.shiftrightunsigned("r", 1), buckets, "slot")
    return slots.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
