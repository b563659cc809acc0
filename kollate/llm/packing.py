"""Filling fixed-capacity containers with items (problem 7).

A grouping genetic algorithm on islands. Items are spread by hash over shards of bounded size; for each
shard and capacity several islands keep a population of packings. A crossover injects the best-filled
containers of one packing whole into another, drops the containers that now hold an item twice, lets the others exchange
an item for a larger displaced one that still fits, and puts what is left back best-fit, largest first. After an epoch the islands pass their elite on to the next
island of the ring, through a shuffle; at the end each shard keeps its best packing. A shard whose
packing reaches the lower bound is done and evolves no further. The least filled containers of all
shards are then pooled and packed once more in fewer shards, and so on up a tree until one shard is left, so that sharding costs
no more than a few containers.

An item longer than the capacity is divided into full containers and a rest; no other is divided. Items
of size zero (empty and null texts) take no room and go to the container numbered 0 of their own.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kollate.session import cut

#: Items a shard has on average, islands of a shard, packings of an island, epochs and generations of one.
SHARD, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4_000, 3, 6, 2, 24
#: Containers that a mutation dissolves, at least and at most, and rounds of exchange after it.
DISSOLVED, EXCHANGES = (2, 8), 2
#: Share of a shard's containers, the least filled, that are packed again with those of other shards.
POOLED = 0.05
#: Budgets there may be; every item is packed once for each.
BUDGETS = 100
#: Islands that one task evolves.
TASK_ISLANDS = 4

Bins = list[list[int]]
#: A packing: its containers and what each holds.
Packing = tuple[Bins, list[int]]


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: Bins | None = None, fill: list[int] | None = None) -> Packing:
    """Puts each item into the container with the least room that holds it, opening one where none does."""
    bins, fill = ([], []) if bins is None else (bins, fill)
    free = sorted((capacity - f, i) for i, f in enumerate(fill) if f < capacity)
    find, put = bisect.bisect_left, bisect.insort
    for item in order:
        size = sizes[item]
        at = find(free, (size, -1))
        if at < len(free):
            left, number = free.pop(at)
            bins[number].append(item)
            fill[number] += size
        else:
            left, number = capacity, len(bins)
            bins.append([item])
            fill.append(size)
        if left > size:
            put(free, (left - size, number))
    return bins, fill


def fitness(fill: list[int], capacity: int) -> float:
    """Mean squared filling: of as many containers, the one with fuller full ones is better."""
    share = np.asarray(fill, float) / capacity
    return float((share * share).mean()) if len(fill) else 1.0


def exchange(sizes: list[int], loose: list[int], capacity: int, bins: Bins, fill: list[int]) -> list[int]:
    """Each container with room, the emptiest first, gives one item for the loose one that fills it best; returns what is loose then.

    So the room gathers in what the loose items need, and whole containers come free."""
    free = sorted((sizes[i], i) for i in loose)
    find, put = bisect.bisect_left, bisect.insort
    for k in sorted(range(len(fill)), key=fill.__getitem__):
        room, gain = capacity - fill[k], 0
        for at, item in enumerate(bins[k] if room else ()):
            j = find(free, (sizes[item] + room + 1, -1)) - 1
            if j >= 0 and free[j][0] - sizes[item] > gain:
                gain, out, into = free[j][0] - sizes[item], at, j
                if gain == room:
                    break
        if gain:
            old = bins[k][out]
            bins[k][out] = free.pop(into)[1]
            fill[k] += gain
            put(free, (sizes[old], old))
    return [i for _, i in free]


def crossover(sizes: list[int], mother: Packing, father: Packing, capacity: int, rng: random.Random) -> Packing:
    """Injects the father's fullest containers into the mother and repairs what that displaces."""
    fill = father[1]
    order = sorted(range(len(fill)), key=fill.__getitem__, reverse=True)
    chosen = order[: rng.randint(1, max(1, len(order) // 2))]
    inside = {i for k in chosen for i in father[0][k]}
    kept = [k for k, b in enumerate(mother[0]) if inside.isdisjoint(b)]
    # Mutation: a few of the emptier containers are dissolved as well.
    for _ in range(rng.randint(*DISSOLVED)):
        if kept:
            kept.pop(min(rng.sample(range(len(kept)), min(4, len(kept))), key=lambda k: mother[1][kept[k]]))
    bins = [list(father[0][k]) for k in chosen] + [list(mother[0][k]) for k in kept]
    filled = [fill[k] for k in chosen] + [mother[1][k] for k in kept]
    placed = inside.union(*(mother[0][k] for k in kept))
    loose = [i for i in range(len(sizes)) if i not in placed]
    for _ in range(EXCHANGES):
        loose = exchange(sizes, loose, capacity, bins, filled)
    return best_fit(sizes, sorted(loose, key=sizes.__getitem__, reverse=True), capacity, bins, filled)


def evolve(sizes: list[int], capacity: int, population: list[Packing], generations: int, seed: int) -> list[Packing]:
    """A population after some generations, best first; ends early at the lower bound."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    rank = lambda k, p: (len(p[0]), -fitness(p[1], capacity), k)
    scored = sorted((rank(k, p), p) for k, p in enumerate(population))
    for step in range(generations):
        if len(scored[0][1][0]) <= least:
            break
        pick = lambda: min(rng.sample(range(len(scored)), min(2, len(scored))))
        child = crossover(sizes, scored[pick()][1], scored[pick()][1], capacity, rng)
        scored = sorted([*scored, (rank(len(population) + step, child), child)])[: max(2, len(population))]
    return [p for _, p in scored]


def _start(sizes: list[int], capacity: int, seed: int) -> list[Packing]:
    rng = random.Random(seed)
    down = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    out = [best_fit(sizes, down, capacity)]
    if len(out[0][0]) <= -(-sum(sizes) // capacity):
        return out
    for k in range(1, POPULATION):
        spread = 0.3 * k / POPULATION
        noisy = [size * (1 + rng.random() * spread) for size in sizes]
        out.append(best_fit(sizes, sorted(down, key=noisy.__getitem__, reverse=True), capacity))
    return out


def _numbers(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for number, b in enumerate(bins):
        out[b] = number
    return out


def _packing(numbers: np.ndarray, sizes: list[int]) -> Packing:
    """A packing from each item's container."""
    bins: Bins = [[] for _ in range(int(numbers.max()) + 1 if len(numbers) else 0)]
    for item, number in enumerate(numbers.tolist()):
        bins[number].append(item)
    return bins, [sum(sizes[i] for i in b) for b in bins]


def _island(epoch: int, generations: int):
    """One epoch of an island: reads the shard's sizes and the elites that reached it, returns its elite."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            elite, count = [], []
            for row in batch.itertuples():
                sizes = np.asarray(row.sizes).tolist()
                seed = hash((row.capacity, row.shard, row.island, epoch)) & 0x7FFFFFFF
                came = [_packing(np.asarray(e, np.int32), sizes) for e in (row.elites if epoch else [])]
                population = came if came else _start(sizes, row.capacity, seed)
                if came and min(len(c[0]) for c in came) > -(-sum(sizes) // row.capacity):
                    population = came + _start(sizes, row.capacity, seed)[1:]
                best = evolve(sizes, row.capacity, population, generations, seed)[0]
                elite.append(_numbers(best[0], len(sizes)))
                count.append(len(best[0]))
            yield batch[["budget", "capacity", "shard", "island"]].assign(elite=elite, bins=count)

    return run


def _pack_shards(items: DataFrame, epochs: int, generations: int) -> DataFrame:
    """(budget, capacity, shard, keys, sizes, elite, bins) of each shard's best packing. ``items``: budget, capacity, shard, key, part, size."""
    listed = F.array_sort(F.collect_list(F.struct("size", "key", "part")))
    shards = items.groupBy("budget", "capacity", "shard").agg(listed.alias("items"))
    shards = cut(shards.select("budget", "capacity", "shard", F.expr("transform(items, x -> x.size)").alias("sizes"), "items"), "shards")
    islands = shards.select("budget", "capacity", "shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    kind = "budget string, capacity int, shard long, island int, elite array<int>, bins int"
    # The work is in the packing, not in the bytes: the number of tasks is given, so that they aren't put together by size.
    tasks = max(1, -(-shards.count() * ISLANDS // TASK_ISLANDS))
    spread = lambda df: df.repartition(tasks, "budget", "shard", "island")
    now = cut(spread(islands).withColumn("elites", F.expr("array(array(0))")).mapInPandas(_island(0, generations), kind), "epoch")
    for epoch in range(1, epochs):
        here = now.select("budget", "capacity", "shard", "island", "elite")
        moved = here.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        elites = here.unionByName(moved).groupBy("budget", "capacity", "shard", "island").agg(F.collect_list("elite").alias("elites"))
        now = cut(spread(islands.join(elites, ["budget", "capacity", "shard", "island"])).mapInPandas(_island(epoch, generations), kind), "epoch", now)
    best = now.groupBy("budget", "capacity", "shard").agg(F.min_by(F.struct("elite", "bins"), F.struct("bins", "island")).alias("best"))
    return shards.join(best.select("budget", "capacity", "shard", "best.elite", "best.bins"), ["budget", "capacity", "shard"])


def _rows(packed: DataFrame) -> DataFrame:
    """(budget, capacity, shard, bins, size, key, part, bin) of each item of packed shards."""
    flat = packed.select("budget", "capacity", "shard", "bins", F.inline(F.arrays_zip("items", F.col("elite").alias("bin"))))
    return flat.select("budget", "capacity", "shard", "bins", "items.*", "bin")


def pack(items: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "n_tokens", epochs: int = EPOCHS, generations: int = GENERATIONS, shard: int = SHARD) -> DataFrame:
    """(budget_name, container, doc_id, part, n_tokens): the container of each item, or of each part of a divided one, for each budget.

    Containers are numbered by strings "level-shard-number" that are unique within a budget; whole containers of
    divided items are "full-key-part" and "none" is that of items without size. Null sizes count as zero;
    repeated rows are items of their own; budgets without a positive capacity are left out, and without any the result is empty.
    """
    plain = items.select(items[key].cast("long").alias("key"), F.coalesce(items[size].cast("long"), F.lit(0)).alias("size"))
    found = budgets.filter("capacity_tokens > 0").select("budget_name", F.col("capacity_tokens").cast("int")).limit(BUDGETS + 1).collect()
    if len(found) > BUDGETS:
        raise ValueError(f"more than {BUDGETS} budgets")
    each = F.array(*[F.struct(F.lit(name).alias("budget"), F.lit(capacity).alias("capacity")) for name, capacity in found]) if found else F.from_json(F.lit("[]"), "array<struct<budget:string,capacity:int>>")
    sized = cut(plain.select("key", "size", F.inline(each)), "sized")  # each item once for each budget
    none = sized.filter("size = 0").select("budget", F.lit("none").alias("container"), "key", F.lit(0).alias("part"), "size")
    parts = sized.filter("size > 0").select("budget", "capacity", "key", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / F.col("capacity")).cast("int"))).alias("part"))
    parts = parts.withColumn("size", F.least(F.col("capacity").cast("long"), F.col("size") - F.col("part") * F.col("capacity")))
    full = parts.filter("size = capacity").select("budget", F.concat(F.lit("full-"), "key", F.lit("-"), "part").alias("container"), "key", "part", "size")
    rest = parts.filter("size < capacity")
    n = rest.groupBy("budget").count().agg(F.max("count")).head()[0] or 0
    shards, level, out = max(1, round(n / shard)), 0, full.unionByName(none)
    while True:
        dealt = rest.select("budget", "capacity", F.pmod(F.xxhash64("key", "part", F.lit(level)), F.lit(shards)).alias("shard"), "key", "part", "size")
        rows = cut(_rows(_pack_shards(dealt, epochs, generations)), "packed")
        named = rows.withColumn("container", F.concat_ws("-", F.lit(level), F.col("shard").cast("string"), "bin"))
        if shards == 1:
            out = out.unionByName(named.select("budget", "container", "key", "part", "size"))
            break
        fill = rows.groupBy("budget", "shard", "bin", "bins").agg(F.sum("size").alias("filled"))
        least = fill.groupBy("budget", "shard").agg(F.array_sort(F.collect_list(F.struct("filled", "bin"))).alias("f"), F.max("bins").alias("bins"))
        pooled = least.select("budget", "shard", F.explode(F.slice("f", 1, F.greatest(F.lit(1), F.ceil(F.col("bins") * POOLED)).cast("int"))).alias("x")).select("budget", "shard", F.col("x.bin").alias("bin"))
        out = out.unionByName(named.join(pooled, ["budget", "shard", "bin"], "left_anti").select("budget", "container", "key", "part", "size"))
        rest = rows.join(pooled, ["budget", "shard", "bin"], "left_semi").select("budget", "capacity", "key", "part", "size")
        shards, level = max(1, round(shards * POOLED)), level + 1
    return out.select(F.col("budget").alias("budget_name"), "container", F.col("key").alias(key), "part", F.col("size").alias(size))


def report(packed: DataFrame, budgets: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(budget_name, capacity_tokens, n_containers, n_tokens, lower_bound, filled): how well each budget's containers are filled."""
    used = packed.filter(F.col("container") != "none").groupBy("budget_name").agg(F.countDistinct("container").alias("n_containers"), F.sum(size).alias("n_tokens"))
    joined = used.join(budgets.select("budget_name", "capacity_tokens"), "budget_name")
    return joined.select("budget_name", "capacity_tokens", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("lower_bound"), F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))
