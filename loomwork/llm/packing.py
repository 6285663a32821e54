"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document is its token ids and an end id; only longer ones than a sequence are cut, and the first piece takes the rest
of the division, so all other pieces fill a sequence. Pieces are dealt by hash into shards of about ``SHARD_ITEMS``. Each
shard is evolved by several islands, one task each: a crossover injects the fullest bins of one packing whole into another,
drops the bins that hold any of their pieces, lets displaced pieces change places with smaller ones where a bin gets
fuller by it, and best-fits the rest; a mutation empties the least full bins and some others. Packings with fewer bins
win, and of equally many bins the one whose empty space lies in fewer bins. A population begins with best-fit decreasing;
where that needs no more bins than all lengths together do, the shard is done, elsewhere it evolves. After each epoch the
islands of a shard send their best packing to the next island. Pieces from the bins that stay poorly filled are dealt anew over shards of
their own, so gaps of different shards meet.

Only a shard's lengths meet in a task; the shard size is fixed and the number of shards follows the corpus. Every stage is
a written table.

Defined results: null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty
one; extra columns don't matter, since only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import documents, shuffle_partitions, staged, text_or_empty, tokenizer_path
from loomwork.llm.tokens import BYTE_BPE, encoder

CAPACITY = 2048
END_ID = 0
SHARD_ITEMS = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
#: Children an epoch and island, and how many without a better packing end it.
GENERATIONS = 40
STALE = 12
#: Bins that displaced pieces try to get into, for each child.
EXCHANGED = 400
#: Bins filled less than this after the first round are packed again with those of other shards.
POOR = 0.985
ROUNDS = 3

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: (uid, doc_id, piece, start, length, ids_crc32)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own, uid = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.doc_id, own.encode(b.text), strict=True):
                ids += end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    to = at + capacity if piece or n % capacity == 0 else n % capacity
                    rows.append((uid, doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    uid, at, piece = uid + 1, to, piece + 1
            out = pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(cut, PIECES)


class Packing:
    """One packing of a shard: bins as lists of item numbers, and the space left in each."""

    __slots__ = ("bins", "left")

    def __init__(self, bins: list[list[int]], left: list[int]):
        self.bins, self.left = bins, left

    def rank(self) -> tuple[int, int]:
        """Smaller is better: fewer bins, then the empty space in fewer bins (the sum of its squares)."""
        return len(self.bins), -sum(x * x for x in self.left)


def best_fit(items: list[int], size: list[int], bins: list[list[int]], left: list[int], capacity: int) -> Packing:
    """Put items, in the order given, each into the bin it fills best."""
    spaces = sorted((space, b) for b, space in enumerate(left))
    for i in items:
        at = bisect.bisect_left(spaces, (size[i], -1))
        if at == len(spaces):
            b = len(bins)
            bins.append([])
            left.append(capacity)
        else:
            b = spaces.pop(at)[1]
        bins[b].append(i)
        left[b] -= size[i]
        bisect.insort(spaces, (left[b], b))
    return Packing(bins, left)


def fewest(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: for each length, longer pieces than half a bin have one each, and
    those that leave less room than that length share none with the pieces from that length to half a bin."""
    x = np.sort(lengths)
    total = np.r_[0, np.cumsum(x)]
    half = int(np.searchsorted(x, capacity / 2, "right"))
    at = np.searchsorted(x, cuts := np.unique(np.r_[0, x[:half]]), "left")  # pieces of at least each of these lengths
    full = np.searchsorted(x, capacity - cuts, "right")
    room = (full - half) * capacity - (total[full] - total[half])
    more = -((-np.maximum(0, total[half] - total[at] - room)) // capacity)
    return int((len(x) - half + more).max())


def exchange(items: list[int], size: list[int], bins: list[list[int]], left: list[int], chance: np.random.Generator) -> list[int]:
    """Let displaced ``items`` take the place of one or two smaller ones in some bins; the items displaced then."""
    free = sorted((size[i], i) for i in items)
    for b in chance.permutation(len(bins))[:EXCHANGED].tolist():
        if not left[b] or not free:
            continue
        own, best = bins[b], (0, 0, 0, 0)
        for x in range(len(own)):
            for y in range(x, len(own)):
                held = size[own[x]] + (size[own[y]] if y > x else 0)
                at = bisect.bisect_right(free, (held + left[b], len(size))) - 1
                if at >= 0 and free[at][0] - held > best[0]:
                    best = (free[at][0] - held, at, x, y)
        gain, at, x, y = best
        if gain:
            gone = [own[x]] if x == y else [own[x], own[y]]
            _, new = free.pop(at)
            bins[b] = [*(i for i in own if i not in gone), new]
            left[b] -= gain
            for i in gone:
                bisect.insort(free, (size[i], i))
    return [i for _, i in reversed(free)]


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, share: float, chance: np.random.Generator) -> Packing:
    """Inject the best-filled bins of ``b`` whole into ``a``; drop bins with duplicates; place what is displaced."""
    keen = np.array(b.left) + chance.integers(0, 1 + capacity // 64, len(b.left))
    chosen = np.argsort(keen, kind="stable")[: max(1, int(share * len(keen)))]
    bins = [list(b.bins[k]) for k in chosen]
    left = [b.left[k] for k in chosen]
    taken = {i for x in bins for i in x}
    displaced: list[int] = []
    for x, space in zip(a.bins, a.left, strict=True):
        if taken.isdisjoint(x):
            bins.append(list(x))
            left.append(space)
        else:
            displaced.extend(i for i in x if i not in taken)
    return _filled(displaced, size, bins, left, capacity, chance)


def mutation(a: Packing, size: list[int], capacity: int, chance: np.random.Generator) -> Packing:
    """Empty the least full bins and some others, and place their items anew."""
    n = len(a.bins)
    worst = np.argsort(-np.array(a.left), kind="stable")[: max(2, n // 50)]
    gone = {*worst.tolist(), *chance.integers(0, n, max(2, n // 20)).tolist()}
    kept = [b for b in range(n) if b not in gone]
    displaced = [i for b in gone for i in a.bins[b]]
    return _filled(displaced, size, [list(a.bins[b]) for b in kept], [a.left[b] for b in kept], capacity, chance)


def _filled(items: list[int], size: list[int], bins: list[list[int]], left: list[int], capacity: int, chance: np.random.Generator) -> Packing:
    items = exchange(items, size, bins, left, chance)
    return best_fit(items, size, bins, left, capacity)


def from_genome(genome: np.ndarray, size: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(int(genome.max()) + 1)]
    for i, b in enumerate(genome.tolist()):
        bins[b].append(i)
    return Packing(bins, [capacity - sum(size[i] for i in x) for x in bins])


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], seed: int, capacity: int = CAPACITY) -> np.ndarray:
    """The best bin number per item after some generations; ``seeds`` are packings to start from."""
    size = lengths.tolist()
    full = [i for i, n in enumerate(size) if n >= capacity]
    rest = [i for i, n in enumerate(size) if n < capacity]
    chance = np.random.default_rng(seed)
    genome = np.zeros(len(size), np.int32)
    genome[full] = np.arange(len(full))
    if not rest:
        return genome
    own = lengths[rest]
    own_size = own.tolist()
    bound = fewest(own, capacity)
    people = []
    for x in seeds:
        _, packed = np.unique(x[rest], return_inverse=True)
        people.append(from_genome(packed, own_size, capacity))
    while len(people) < POPULATION and not any(len(p.bins) <= bound for p in people):
        # The first is best-fit decreasing; the others take the items in a slightly shuffled order.
        noise = 0 if not people else chance.uniform(-0.08, 0.08, len(own)) * capacity
        order = np.argsort(-(own + noise), kind="stable").tolist()
        people.append(best_fit(order, own_size, [], [], capacity))
    people.sort(key=Packing.rank)
    stale = 0
    for _ in range(GENERATIONS):
        if len(people[0].bins) <= bound or stale >= STALE:
            break
        i, j = sorted(chance.choice(len(people), 2, replace=False).tolist())
        if chance.random() < 0.5:
            child = crossover(people[i], people[j], own_size, capacity, float(chance.uniform(0.05, 0.6)), chance)
        else:
            child = mutation(people[i], own_size, capacity, chance)
        stale = 0 if child.rank() < people[0].rank() else stale + 1
        people.append(child)
        people.sort(key=Packing.rank)
        people.pop()
    for b, x in enumerate(people[0].bins):
        for k in x:
            genome[rest[k]] = len(full) + b
    return genome


def _place(lengths: np.ndarray, genome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each item in its bin, and the bin's fill, items of a bin in their order."""
    order = np.argsort(genome, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, genome[order][1:] != genome[order][:-1]]
    start = np.maximum.accumulate(np.where(first, before, 0))
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = before - start
    fill = np.bincount(genome, weights=lengths).astype(np.int64)
    return offsets, fill[genome]


ELITE = "shard long, island int, genome array<int>, offsets array<long>, fills array<long>, bins int, fitness double"


def _island(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                lengths = np.asarray(x.lengths, np.int64)
                seeds = [np.asarray(g, np.int32) for g in (x.own, x.guest) if g is not None]
                genome = evolve(lengths, seeds, hash((x.shard, x.island, epoch)) & 0xFFFFFFFF, capacity)
                offsets, fills = _place(lengths, genome)
                fill = np.bincount(genome, weights=lengths) / capacity
                rows.append((x.shard, x.island, genome, offsets, fills, len(fill), float((fill**2).mean())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELITE.split(", ")])

    return run


def pack_round(items: DataFrame, n_items: int, capacity: int, salt: int) -> DataFrame:
    """``items`` (uid, length and more) with shard, bin, offset and fill."""
    spark = items.sparkSession
    shards, tasks = max(1, -(-n_items // SHARD_ITEMS)), shuffle_partitions(spark)
    shard = F.pmod(F.xxhash64(F.lit(salt), F.col("uid")), F.lit(shards)).alias("shard")
    row = F.struct(*[F.col(c) for c in items.columns])
    groups = items.select(shard, row.alias("item")).groupBy("shard")
    groups = staged(groups.agg(F.sort_array(F.collect_list("item")).alias("items")), f"pack-shards-{salt}")
    lengths = groups.select("shard", F.transform("items", lambda x: x["length"]).alias("lengths"))
    nobody = F.lit(None).cast("array<int>")
    tribes = lengths.select(
        "shard", "lengths", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island")
    ).select("shard", "island", "lengths", nobody.alias("own"), nobody.alias("guest"))
    for epoch in range(EPOCHS):
        dealt = tribes.repartition(tasks, "shard", "island")
        elite = staged(dealt.mapInPandas(_island(capacity, epoch), ELITE), f"pack-elite-{salt}-{epoch}")
        guests = elite.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("genome").alias("guest"))
        home = elite.select("shard", "island", F.col("genome").alias("own"))
        tribes = home.join(guests, ["shard", "island"]).join(lengths, "shard")
        tribes = tribes.select("shard", "island", "lengths", "own", "guest")
    rank = F.struct(-F.col("bins"), F.col("fitness"), -F.col("island"))
    best = elite.groupBy("shard").agg(F.max_by(F.struct("genome", "offsets", "fills"), rank).alias("best"))
    zipped = F.arrays_zip("items", F.col("best.genome"), F.col("best.offsets"), F.col("best.fills"))
    packed = groups.join(best, "shard").select("shard", F.explode(zipped).alias("x"))
    return packed.select(
        "x.items.*",
        "shard",
        F.col("x.genome").cast("long").alias("bin"),
        F.col("x.offsets").alias("offset"),
        F.col("x.fills").alias("fill"),
    )


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (uid and length, both long, and more columns) with sequence_id and offset."""
    done, rest, n = None, items, items.count()
    for salt in range(rounds):
        if n == 0 and done is not None:
            break
        placed = staged(pack_round(rest, n, capacity, salt), f"packed-{salt}")
        poor = F.col("fill") < int(POOR * capacity)
        last = salt == rounds - 1 or n <= SHARD_ITEMS
        kept = placed if last else placed.filter(~poor)
        kept = kept.select(
            *items.columns,
            (F.lit(salt).cast("long") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"),
            "offset",
        )
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        rest = placed.filter(poor).select(*items.columns)
        n = rest.count()
    return done


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    packed = pack(staged(pieces_of(docs, tokenizer, capacity), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))
