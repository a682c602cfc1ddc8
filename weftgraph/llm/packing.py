"""Filling containers of fixed capacity with documents, by linear grouping.

Sizes of large documents are rounded up within groups of equal cardinality. How few distinct sizes
go into containers is settled once, over a histogram of at most ``capacity`` rows; documents then
take the places of their group by their number, which is plain arithmetic. Small documents go by
best fit into what is left, in shards of bounded size.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A document is large if it takes more than this part of a container.
LARGE = 1 / 8
#: Groups of large documents: distinct sizes that containers are made up of.
GROUPS = 96
#: Hash ranges within which the documents of a group are numbered.
RANGES = 256
#: Small documents, or containers with room, that one task fits at most (on average).
SHARD = 20_000
#: Packs that one plan fills, each with a copy of every document; more are filled one batch after the other.
PACK_BATCH = 100


SCHEMA = "pack_name string, container string, doc_id long, piece long, n_tokens long"


def pieces(sizes: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, doc_id, piece, n_tokens): each document once for each pack, split only where it exceeds the capacity alone."""
    pack = F.explode(F.array(*(F.struct(F.lit(name).alias("pack_name"), F.lit(int(c)).cast("long").alias("capacity")) for name, c in packs))).alias("p")
    rows = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", pack).select("doc_id", "n_tokens", "p.*")
    numbered = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_tokens - 1) div capacity"))))
    return numbered.select("pack_name", "capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("n_tokens"))


def group_sizes(histogram: dict[int, int], groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(least size, greatest size, documents) of groups of about equal cardinality, largest sizes first."""
    share, found, n, top = sum(histogram.values()) / groups, [], 0, None
    for size in sorted(histogram, reverse=True):
        top = size if top is None else top
        n += histogram[size]
        if n >= share:
            found.append((size, top, n))
            n, top = 0, None
    if n:
        found.append((min(histogram), top, n))
    return found


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(documents of each size, containers): the largest size left goes with the fullest complement that is left, as often as it can.

    Each round uses up at least one size, so there are at most as many rounds as twice the sizes.
    """
    left, found = list(counts), []
    while any(left):
        first = next(i for i, n in enumerate(left) if n)
        room = capacity - sizes[first]
        # reach[c]: how the fill c came about, as (size, documents of it, fill before); the fullest is taken.
        reach: list[tuple[int, int, int] | None] = [None] * (room + 1)
        filled = np.zeros(room + 1, bool)
        filled[0] = True
        for i, size in enumerate(sizes):
            most = min((left[i] - (i == first)), room // size if size else 0)
            before = np.flatnonzero(filled)
            for m in range(1, most + 1):
                new = before + m * size
                new = new[new <= room]
                if not len(new):
                    break
                new = new[~filled[new]]
                for c in new:
                    reach[c] = (i, m, int(c) - m * size)
                filled[new] = True
            if filled[room]:
                break
        used: dict[int, int] = {first: 1}
        c = int(np.flatnonzero(filled)[-1])
        while c:
            i, m, c = reach[c]
            used[i] = used.get(i, 0) + m
        times = min(left[i] // m for i, m in used.items())
        for i, m in used.items():
            left[i] -= m * times
        found.append((used, times))
    return found


def fill(small: list[int], rooms: list[int], capacity: int) -> tuple[list[int], int]:
    """The container of each small document: best fit, largest first; numbers past ``rooms`` are new containers. Also how many are new."""
    space = sorted((room, k) for k, room in enumerate(rooms) if room > 0)
    place, n = [0] * len(small), len(rooms)
    for d in sorted(range(len(small)), key=lambda d: -small[d]):
        at = bisect.bisect_left(space, (small[d], -1))
        if at < len(space):
            room, k = space.pop(at)
        else:
            room, k, n = capacity, n, n + 1
        place[d] = k
        if room > small[d]:
            bisect.insort(space, (room - small[d], k))
    return place, n - len(rooms)


def pack(sizes: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(pack_name, container, doc_id, piece, n_tokens): every document in a container of each pack, none overfull.

    A document is whole (piece 0 only) unless it alone exceeds the capacity; then it is split into
    full pieces and a rest. Documents without tokens take no room and are left out; packs with a
    null name or without capacity are no packs, and of a name given twice the larger holds.
    """
    spark = sizes.sparkSession
    packs = [(r[0], r[1]) for r in pack_sizes.where("pack_name is not null and capacity > 0").groupBy("pack_name").agg(F.max("capacity")).orderBy("pack_name").collect()]  # a row for each pack
    if not packs:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, (_pack_batch(sizes, packs[k : k + PACK_BATCH]) for k in range(0, len(packs), PACK_BATCH)))


def _pack_batch(sizes: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    spark = sizes.sparkSession
    items = pieces(sizes, packs)
    full = items.where("n_tokens = capacity").select("pack_name", F.concat(F.lit("whole/"), F.col("doc_id"), F.lit("/"), F.col("piece")).alias("container"), "doc_id", "piece", "n_tokens")
    rest = items.where("n_tokens < capacity")
    is_large = F.col("n_tokens") > F.col("capacity") * LARGE

    # At most `capacity` rows a pack reach the driver, however many documents there are.
    seen: dict[str, dict[int, int]] = {name: {} for name, _ in packs}
    n_small = dict.fromkeys(seen, 0)
    for name, large, size, n in rest.groupBy("pack_name", is_large.alias("large"), F.when(is_large, F.col("n_tokens")).alias("n_tokens")).count().collect():
        if large:
            seen[name][size] = n
        else:
            n_small[name] = n
    groups, places, shards = [], [], {}
    for name, capacity in packs:
        made = group_sizes(seen[name]) if seen[name] else []
        groups += [(name, low, high, g) for g, (low, high, _) in enumerate(made)]
        taken, base = [0] * len(made), 0
        for used, times in configurations([high for _, high, _ in made], [n for _, _, n in made], capacity):
            for g, m in used.items():
                places.append((name, g, taken[g], taken[g] + m * times, m, base))
                taken[g] += m * times
            base += times
        shards[name] = max(1, -(-max(n_small[name], base) // SHARD))
    groups = spark.createDataFrame(groups, "pack_name string, low long, high long, g int")  # at most GROUPS rows a pack
    places = spark.createDataFrame(places, "pack_name string, g int, first long, last long, each int, base long")  # at most a few hundred rows a pack

    # Every group in turn: the number of a document is its number in a range of the hash, after those of the ranges before.
    size_group = F.broadcast(groups.select("pack_name", F.explode(F.sequence("low", "high")).alias("n_tokens"), "g"))  # a row for each size
    large = rest.where(is_large).join(size_group, ["pack_name", "n_tokens"]).withColumn("range", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANGES)).cast("int"))
    ahead = Window.partitionBy("pack_name", "g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = large.groupBy("pack_name", "g", "range").count().select("pack_name", "g", "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))  # RANGES rows a group
    in_range = Window.partitionBy("pack_name", "g", "range").orderBy(F.desc("n_tokens"), "doc_id", "piece")
    numbered = large.withColumn("number", F.row_number().over(in_range) - 1).join(F.broadcast(offsets), ["pack_name", "g", "range"]).withColumn("number", F.col("number") + F.col("ahead"))
    put = numbered.join(F.broadcast(places), ["pack_name", "g"]).where("number >= first and number < last")
    put = cut_lineage(put.select("pack_name", "capacity", (F.col("base") + F.expr("(number - first) div each")).alias("c"), "doc_id", "piece", "n_tokens"))

    shard_count = F.create_map(*(x for name, n in shards.items() for x in (F.lit(name), F.lit(n))))[F.col("pack_name")]
    rooms = put.groupBy("pack_name", "capacity", "c").agg((F.first("capacity") - F.sum("n_tokens")).alias("room"))
    rooms = rooms.where("room > 0").withColumn("shard", F.pmod(F.xxhash64("c"), shard_count).cast("int"))
    small = rest.where(~is_large).withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "doc_id", "piece"), shard_count).cast("int"))
    both = small.select("pack_name", "capacity", "shard", "doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("c")).unionByName(
        rooms.select("pack_name", "capacity", "shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("piece"), F.col("room").alias("n_tokens"), "c")
    )

    def best_fit(rows: pd.DataFrame) -> pd.DataFrame:
        is_room = rows["c"].notna()
        room = rows[is_room].sort_values(["n_tokens", "c"])
        docs = rows[~is_room].sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        place, _ = fill(docs["n_tokens"].astype(int).tolist(), room["n_tokens"].astype(int).tolist(), int(rows["capacity"].iloc[0]))
        names, shard = [f"large/{int(c)}" for c in room["c"]], rows["shard"].iloc[0]
        container = [names[k] if k < len(names) else f"small/{shard}/{k - len(names)}" for k in place]
        # The type of the new column is stated, as a shard may have rooms and no documents.
        out = docs.assign(container=pd.Series(container, index=docs.index, dtype=object)).astype({"doc_id": "int64", "piece": "int64"})
        return out[["pack_name", "container", "doc_id", "piece", "n_tokens"]]

    fitted = both.groupBy("pack_name", "shard").applyInPandas(best_fit, SCHEMA)
    return put.select("pack_name", F.concat(F.lit("large/"), F.col("c")).alias("container"), "doc_id", "piece", "n_tokens").unionByName(fitted).unionByName(full)


def fill_report(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, tokens, fill) of every pack that has containers."""
    each = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    packs = pack_sizes.groupBy("pack_name").agg(F.max("capacity").alias("capacity"))
    return each.join(F.broadcast(packs), "pack_name").select("pack_name", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
