"""Operator 2, sharding by balanced label propagation, in DataFrame operations only.

Linked documents share a group (here: the text).  The state is one label (shard) per
*atom*: the members of a group that a hash of the row puts in the same sub-number.  An
atom stands for the same documents all along, so the rounds move pre-aggregated counts,
and a group of a third of all rows is spread over many atoms of bounded size.

A group starts as one piece, spread over the shards.  In a round every piece without a home
asks to move to a shard that can hold it whole: where most of it is (its neighbours), else
one drawn in proportion to the room.  A shard grants the largest requests first, up to its
room.  A piece that no shard can hold any more is cut at the largest room.  Rounds go on until
nothing is left that fits; no shard's linked documents outgrow its capacity.

Unlinked documents have no neighbours; they fill the shards up.  The last step makes the
law exact: each shard keeps its first documents, linked ones first, up to its size
(row counts at most one apart), and what is over takes the free places of other shards.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import forget, hot_split_join, written

#: Rows an atom of a large group has at most, about.
ATOM_ROWS = 50_000
#: Rows one window task numbers, about.
SLICE_ROWS = 200_000
#: Rounds of one propagation at most; reaching it is reported.
MOST_ROUNDS = 200


def _subs(total: int, shards: int) -> int:
    """Atoms a group may have: a multiple of the shard count, at least 8 per shard."""
    return shards * max(8, -(-total // (shards * ATOM_ROWS)))


def propagate(atoms: DataFrame, shards: int, capacity: int, rounds: int, taken: DataFrame | None = None,
              largest_first: bool = False, most: int = MOST_ROUNDS) -> DataFrame:
    """``atoms`` (group columns _g1 _g2, _sub, n, label) that found a home, with its label.

    ``taken`` (label, load) is what other atoms already hold of each shard's capacity.  Rounds
    go on until every piece has a home or what is left fits nowhere; ``rounds`` of them in a row
    without a grant, or ``most`` in all, end it too, the latter with a warning.  With
    ``largest_first`` only pieces at least half as large as the largest one ask.
    """
    key = ["_g1", "_g2", "_part"]
    room = [capacity] * shards
    for r in taken.collect() if taken is not None else []:       # one row per shard
        room[r["label"]] -= r["load"]
    left = written(atoms.withColumn("_part", F.lit(0).cast("bigint")), "atoms")
    homes, idle = [], 0
    for step in range(most):
        best = max(room)
        # At most one population per shard: the map is bounded.
        pops = (left.groupBy(*key, "label").agg(F.sum("n").alias("pop"), F.count(F.lit(1)).alias("atoms"),
                                                F.max("n").alias("top"))
                .groupBy(*key).agg(F.sum("pop").alias("size"), F.sum("atoms").alias("atoms"), F.max("top").alias("top"),
                                   F.map_from_entries(F.collect_list(F.struct("label", "pop"))).alias("pops")))
        pieces = written(pops, "pieces")
        seen = pieces.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("size") <= best, F.col("size"))).alias("top"),
                          F.sum(((F.col("size") > best) & (F.col("atoms") > 1)).cast("int")).alias("wide")).first()
        if best <= 0 or (seen["top"] is None and not seen["wide"]) or idle >= rounds:
            break
        # Of the shards it fits into, a piece asks for the one with most of it, then for one
        # drawn by a hash in proportion to the room: the requests spread.
        places = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(x).cast("bigint").alias("room"))
                           for i, x in enumerate(room) if x > 0])

        def wish(p):
            draw = (F.pmod(F.xxhash64("_g1", "_g2", "_part", p["to"], F.lit(step)), F.lit(1 << 30)) + 1) / float(1 << 30)
            return F.struct(F.coalesce(F.try_element_at("pops", p["to"]), F.lit(0)).alias("pop"),
                            (F.log(draw) / p["room"]).alias("draw"), p["to"].alias("to"))

        least = (seen["top"] or 0) / 2 if largest_first else 0
        fits = F.filter(places, lambda p: p["room"] >= F.col("size"))
        asked = (pieces.where((F.col("size") <= best) & (F.col("size") >= least))
                 .select(*key, "size", F.array_max(F.transform(fits, wish)).alias("wish"))
                 .select(*key, "size", F.col("wish.to").alias("to"), F.col("wish.pop").alias("pop")))
        asked = written(asked, "asked")
        sums = {r["to"]: (r["x"], r["c"]) for r in asked.groupBy("to").agg(
            F.sum("size").alias("x"), F.count(F.lit(1)).alias("c")).collect()}      # one row per shard
        # One slice after a round without a grant: its first request always fits.
        slices = 1 if idle else max([1, *[-(-c // SLICE_ROWS) for _, c in sums.values()]])
        asked = asked.withColumn("_slice", F.pmod(F.xxhash64("_g1", "_part"), F.lit(slices)))
        rate = F.element_at(F.array(*[F.lit(x / sums[i][0] if i in sums else 0.0) for i, x in enumerate(room)]),
                            F.col("to") + 1)
        full = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in room]), F.col("to") + 1)
        quota = asked.groupBy("to", "_slice").agg(F.sum("size").alias("x")).select(
            "to", "_slice", (F.floor(F.col("x") * rate) if slices > 1 else full).alias("quota"))
        first = (Window.partitionBy("to", "_slice").orderBy(F.col("size").desc(), F.col("pop").desc(), *key)
                 .rowsBetween(Window.unboundedPreceding, 0))
        granted = written(asked.withColumn("run", F.sum("size").over(first)).join(F.broadcast(quota), ["to", "_slice"])
                          .where(F.col("run") <= F.col("quota")).select(*key, "to", "size"), "granted")
        loads = granted.groupBy("to").agg(F.sum("size").alias("load")).collect()
        for r in loads:
            room[r["to"]] -= r["load"]
        idle = 0 if loads or seen["wide"] else idle + 1
        state = pieces.select(*key, "size", "atoms", "top").join(granted.drop("size"), key, "left")
        state = left.join(state, key)
        homes.append(written(state.where("to is not null").select("_g1", "_g2", "_sub", "n", F.col("to").alias("label")),
                             "homes"))
        # What fits nowhere is cut into pieces of the largest room; a single atom stays as it is.
        run = F.sum("n").over(Window.partitionBy(*key).orderBy("_sub").rowsBetween(Window.unboundedPreceding, 0))
        cut = F.floor((run - 1) / F.greatest(F.lit(best) - F.col("top"), F.lit(1)))
        wide = state.where((F.col("size") > best) & (F.col("atoms") > 1)).withColumn("_part", F.xxhash64("_part", cut))
        rest = state.where((F.col("size") <= best) & F.col("to").isNull()).unionByName(wide)
        rest = written(rest.select("_g1", "_g2", "_sub", "n", "label", "_part"), "atoms")
        for old in (left, pieces, asked, granted):
            forget(old)
        left = rest
    else:
        logging.getLogger(__name__).warning("%d atoms without a home after %d rounds", left.count(), most)
    out = atoms.select("_g1", "_g2", "_sub", "n", "label").limit(0)
    for h in homes:
        out = out.unionByName(h)
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
          rounds: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot; counts at most one apart.

    Documents with equal texts (null: empty) are linked.  ``size`` is the UTF-8 bytes plus 8,
    ``slot`` numbers a shard's rows from 0.  Null and repeated ids are rows like any other;
    other columns are not read; an empty table gives no rows.  ``rounds``: see ``propagate``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_g1"),
        F.xxhash64(F.lit(1), text).alias("_g2"), F.monotonically_increasing_id().alias("_row"))
    base = written(base.withColumn("_h", F.xxhash64("_row", "_g1")), "rows")
    total = base.count()
    capacity = max(1, total // shards)
    subs = _subs(total, shards)
    sub = F.pmod("_h", F.lit(subs)).cast("int")
    start = F.pmod("_h", F.lit(shards)).cast("int")     # subs is a multiple of shards
    counts = base.withColumn("_sub", sub).groupBy("_g1", "_g2", "_sub").agg(F.count(F.lit(1)).alias("n"))
    linked = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("_g1", "_g2"))).where("_all > 1")
    linked = written(linked.withColumn("label", F.pmod("_sub", F.lit(shards)).cast("int")), "linked")
    # Groups that take much of a shard find their homes first; the others use the room left.
    large = F.col("_all") * 8 >= capacity
    first = written(propagate(linked.where(large).drop("_all"), shards, capacity, rounds, largest_first=True), "homes")
    taken = first.groupBy("label").agg(F.sum("n").alias("load"))
    then = propagate(linked.where(~large).drop("_all"), shards, capacity, rounds, taken)
    labels = (first.withColumn("_class", F.lit(0)).unionByName(then.withColumn("_class", F.lit(1)))
              .withColumnRenamed("n", "_n"))
    placed = hot_split_join(base.withColumn("_sub", sub), labels, ["_g1", "_g2", "_sub"], "_n", total)
    placed = placed.select("_id", "size", "text_crc32", "_g1", "_h", "_row", F.coalesce("_class", F.lit(2)).alias("_class"),
                           F.coalesce("label", start).alias("_to"))
    return _level(placed, shards, total).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _level(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """Exact row counts: ``placed`` (_to, _class, _g1, _h, _row) with final shard and slot.

    A shard's rows are numbered large groups first, then other linked rows, unlinked ones
    last, in slices of a bounded number of rows; rows numbered beyond the shard's size go,
    in order, to the free places of the shards that have some.
    """
    # Small groups stay together in slices by group; large ones and unlinked rows go by row.
    parts = max(1, -(-total // (shards * SLICE_ROWS)))
    slice_ = F.col("_class") * parts + F.when(F.col("_class") == 2, F.pmod("_h", F.lit(parts))).otherwise(
        F.pmod("_g1", F.lit(parts)))
    fine = F.when(F.col("_class") == 0, F.pmod(F.shiftright("_h", 7), F.lit(8 * parts))).otherwise(0)
    placed = written(placed.withColumn("_s1", slice_.cast("bigint")).withColumn("_s2", fine.cast("bigint")), "placed")
    per = placed.groupBy("_to", "_s1", "_s2").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("_to").orderBy("_s1", "_s2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per.withColumn("_off", F.coalesce(F.sum("c").over(before), F.lit(0))), "offsets")
    # 24 rows: what each shard has, may have, has over and lacks, and where that begins.
    every = placed.sparkSession.range(shards).select(F.col("id").cast("int").alias("_to"))
    loads = every.join(offsets.groupBy("_to").agg(F.sum("c").alias("load")), "_to", "left").select(
        "_to", F.coalesce("load", F.lit(0)).alias("load"))
    want = F.lit(total // shards) + (F.col("_to") < total % shards).cast("int")
    loads = loads.withColumn("want", want).withColumn("over", F.greatest(F.col("load") - want, F.lit(0))).withColumn(
        "free", F.greatest(want - F.col("load"), F.lit(0)))
    prior = Window.orderBy("_to").rowsBetween(Window.unboundedPreceding, -1)
    loads = written(loads.withColumn("over_at", F.coalesce(F.sum("over").over(prior), F.lit(0)))
                    .withColumn("free_at", F.coalesce(F.sum("free").over(prior), F.lit(0))), "loads")
    inside = Window.partitionBy("_to", "_s1", "_s2").orderBy("_g1", "_h", "_row")
    ranked = (placed.withColumn("_k", F.row_number().over(inside) - 1)
              .join(offsets.drop("c"), ["_to", "_s1", "_s2"])
              .withColumn("_pos", F.col("_off") + F.col("_k"))
              .join(F.broadcast(loads.select("_to", "want", "over_at")), "_to"))
    # The free places as one array of (first, shard, first slot): at most one per shard.
    gaps = loads.where("free > 0").agg(F.sort_array(F.collect_list(F.struct(
        "free_at", F.col("_to").alias("to"), F.col("load").alias("slot")))).alias("gaps"))
    extra = F.col("over_at") + F.col("_pos") - F.col("want")
    ranked = ranked.withColumn("_gaps", gaps.scalar())
    gap = F.element_at(F.filter("_gaps", lambda g: g["free_at"] <= extra), -1)
    moved = F.col("_pos") >= F.col("want")
    return (ranked.withColumn("_gap", F.when(moved, gap))
            .withColumn("shard", F.when(moved, F.col("_gap.to")).otherwise(F.col("_to")).cast("int"))
            .withColumn("slot", F.when(moved, F.col("_gap.slot") + extra - F.col("_gap.free_at"))
                        .otherwise(F.col("_pos")).cast("bigint")))


def cut_links(placed: DataFrame, group: str, shard_col: str = "shard") -> DataFrame:
    """One row: pairs of equal ``group`` in all, and how many of them lie in two shards."""
    pairs = lambda n: n * (n - 1) / 2
    per = placed.groupBy(group, shard_col).agg(F.count(F.lit(1)).alias("n"))
    both = per.groupBy(group).agg(F.sum("n").alias("t"), F.sum(pairs(F.col("n"))).alias("kept"))
    return both.agg(F.sum(pairs(F.col("t"))).alias("links"), F.sum(pairs(F.col("t")) - F.col("kept")).alias("cut"))
