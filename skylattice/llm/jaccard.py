"""Exact Jaccard join of word-shingle sets in their metric space.

1 - Jaccard is a metric. Documents with equal sets are one point. Almost all points are at distance
1 from any given document, where windows around document pivots exclude nothing, so the pivots of
the first level are single shingles. A point belongs to the regions of its prefix, the shingles
that come first in one order of all shingles: two sets with similarity t or more always share one
within the first n - ceil(t n) + 1, which is the window that replicates a point to every region it
can have a partner in. The order is by hash, but shingles that several documents hold come after the
others, commonest last, so passages that documents share make no regions unless a document consists
of them; the order decides only speed. As most prefixes lie among the smallest hashes, only those
are counted over all documents, and the others over the documents whose prefixes reach further.

The pairs of a region of at most SMALL points are listed, and how often a pair met bounds what its
sets share, so that few pairs need their whole sets compared. In larger regions PIVOTS of the
documents become pivots. Points at distance r = 1 - t or less from one are links. Every point goes
to the Voronoi region of its nearest pivot, and as a guest to all whose pivot is at most 2 r further
away: by the triangle inequality two points within r then meet in the home of either. Regions join
recursively. A region is compared once few pairs for each point are left that no chain of links
joins, or when its points are so far from all pivots that a split did not part them; then the points
outside of its largest component meet all others, in blocks.

Defined results: a null or wordless text has no shingles and no links; fewer words than a shingle
make one shingle of the whole sequence; shingles are told by 64 bits of hashes, equal sets by 64 of
their own and the size; repeated rows and copies share the class of the smallest id; a null id is in
a class but never the smallest of one with other ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components, joined_components

WORDS, PERCENT = 4, 85
#: Layout only: of the lowest hashes, reach times the share of a prefix, shingles that FEWEST documents hold are frequent; FREQUENT_MOST of these and as many others are known to all tasks.
REACH, FEWEST, FREQUENT_MOST = 1.3, 6, 400_000
#: Points of a region whose pairs are listed; pivots of a larger one; pairs for each point of a region that is compared; points of a block; of its region's points, those that a region may have after a split that parted them.
SMALL, PIVOTS, LEAF, BLOCK, PARTED = 32, 3, 64, 4096, 0.8
#: Bits of the filter of the texts whose whole sets are needed; beyond so many texts it only lets more through.
FILTER_BITS = 1 << 25
POINTS = "doc_id long, text_key long, point long, n long, prefix array<long>, rest string"
REGIONS = "a long, b long, n_a long, n_b long, region long, place int"


def shingles(block: tk.Block, words: int, below: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit shingle), sorted, each once a text; words are lower-cased in ASCII. Only hashes under `below`, if given."""
    block = block.lowered()
    starts, ends, owner = block.words()
    hashes = block.apart(starts, ends)
    window, at = tk.word_windows(hashes, owner, words)
    count = np.bincount(owner, minlength=block.n)
    short = np.flatnonzero((count > 0) & (count < words))
    whole, first = np.zeros(len(short), np.uint64), np.searchsorted(owner, short)
    for k in range(words - 1):
        more = count[short] > k
        whole[more] = tk.mix(whole[more] * np.uint64(tk.BASE) + hashes[first[more] + k] + np.uint64(k + 1))
    text, token = owner[at], window
    if len(short):
        place = np.searchsorted(text, short)
        text, token = np.insert(text, place, short), np.insert(token, place, whole)
    if below is not None:
        low = token < below
        text, token = text[low], token[low]
    edges = np.searchsorted(text, np.arange(block.n + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        token[a:b].sort()
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    return text[new], token[new]


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.view(np.int64)))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def lowest(percent: int) -> np.uint64:
    """Hashes below are counted over all documents."""
    return np.uint64(min(0.9, REACH * (100 - percent) / 100) * 2**64)


class Frequent:
    """Frequent shingles, sorted, with the power of two of their counts."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        order = np.argsort(token)
        self.token, self.level = token[order], np.log2(np.maximum(n[order], 1)).astype(np.uint8)

    def levels(self, token: np.ndarray) -> np.ndarray:
        """0 for those that are not frequent."""
        if not len(self.token):
            return np.zeros(len(token), np.uint8)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        return np.where(self.token[at] == token, self.level[at], 0).astype(np.uint8)

    def joined(self, other: Frequent) -> Frequent:
        both = Frequent(np.concatenate([self.token, other.token]), np.ones(len(self.token) + len(other.token)))
        both.level = np.concatenate([self.level, other.level])[np.argsort(np.concatenate([self.token, other.token]))]
        return both


def counting(words: int, low: np.uint64, beyond: bool):
    """Texts to (token, n): how many texts of a batch hold each shingle below `low`, or beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.zeros(0, np.uint64)]
            for part in tk.slices(batch, "text"):
                _, token = shingles(tk.string_block(part.column("text")), words, None if beyond else low)
                held.append(token[token >= low] if beyond else token)
            token, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def frequent_shingles(spark: SparkSession, texts: DataFrame, words: int, low: np.uint64, beyond: bool) -> Frequent:
    """The commonest of the shingles that FEWEST texts hold, FREQUENT_MOST at most: a count bounds them before they are fetched."""
    counts = texts.mapInArrow(counting(words, low, beyond), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)
    counts = tk.materialize(spark, counts, "counts")
    least, held = FEWEST, 0
    for level, found in sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n"))).count().collect()), reverse=True):
        if held + found > FREQUENT_MOST:
            least = 2 ** (level + 1)
            break
        held += found
    found = counts.where(F.col("n") >= least).toPandas()
    tk.discard(spark, counts)
    return Frequent(found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64))


def pointing(words: int, percent: int, frequent: Frequent, low: np.uint64, last: bool):
    """Texts to POINTS. Texts whose prefix reaches shingles that were not counted come out as rest, unless this is the last turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                block = tk.string_block(part.column("text"))
                text, token = shingles(block, words)
                n = np.bincount(text, minlength=block.n)
                total = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(token + np.uint64(1)), dtype=np.uint64)])
                edges = np.concatenate([[0], np.cumsum(n)])
                point = tk.mix((total[edges[1:]] - total[edges[:-1]]) * np.uint64(tk.BASE) + n.astype(np.uint64))
                length = prefix_length(n, percent)
                counted = np.ones(len(token), bool) if last else token < low
                level = np.zeros(len(token), np.uint8)
                level[counted] = frequent.levels(token[counted])
                rest = np.zeros(block.n, bool) if last else np.bincount(text[counted & (level == 0)], minlength=block.n) < length
                kept = ~rest[text] & (counted & (level == 0) if not last else True)
                text, token, level = text[kept], token[kept], level[kept]
                if last:
                    order = np.lexsort((token, level, text))
                    text, token = text[order], token[order]
                rank = np.arange(len(text)) - np.searchsorted(text, np.arange(block.n))[text]
                length = np.where(rest, 0, length)
                prefix = lists(token[rank < length[text]], length)
                texts = part.column("text")
                unfinished = texts.filter(pa.array(rest)).to_pylist() if rest.any() else []
                where = np.full(block.n, -1)
                where[rest] = np.arange(len(unfinished))
                column = pa.array([unfinished[k] if k >= 0 else None for k in where], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(point.view(np.int64)), pa.array(n.astype(np.int64)), prefix, column], [x.split()[0] for x in POINTS.split(", ")])

    return run


def meeting(percent: int):
    """(region, point, n, place), sorted by region and point, to REGIONS: the pairs of regions of 2 to SMALL points
    whose sizes can be near, and with b null the points of larger ones. place: of the shingle in the point's prefix."""
    names = [x.split()[0] for x in REGIONS.split(", ")]

    def out(a, b, n_a, n_b, region, place) -> pa.RecordBatch:
        filled = [pa.nulls(len(a), pa.int32() if name == "place" else pa.int64()) if x is None else pa.array(x) for name, x in zip(names, (a, b, n_a, n_b, region, place), strict=True)]
        return pa.RecordBatch.from_arrays(filled, names)

    def complete(region, point, n, place, large) -> Iterator[pa.RecordBatch]:
        """Whole regions; large: one that began earlier as a large one, or None."""
        start = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(start, len(region)))
        big = size > SMALL
        if large is not None and len(region):
            big[0] |= region[0] == large
        held = np.repeat(big, size)
        if held.any():
            yield out(point[held], None, n[held], None, region[held], place[held])
        for s in np.unique(size[~big & (size > 1)]):
            at = start[~big & (size == s)][:, None]
            i, j = np.triu_indices(s, 1)
            x, y = (at + i).ravel(), (at + j).ravel()
            near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[near], y[near]
            yield out(point[x], point[y], n[x], n[y], region[x], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.int32)], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # where the last region begins
            yield from complete(*(x[:last] for x in rows), large)
            held = [x[last:] for x in rows]
            if large is not None and held[0][0] != large:
                large = None
            if len(held[0]) > SMALL or large is not None:
                large = int(held[0][0])
                yield out(held[1], None, held[2], None, held[0], held[3])
                held = [x[:0] for x in held]
        yield from complete(*held, large)

    return run


def needed_filter(keys: DataFrame) -> np.ndarray:
    """FILTER_BITS flags, packed by 64, those of the keys (text_key) set; as large whatever the keys are."""
    flagged = keys.select(F.pmod("text_key", F.lit(FILTER_BITS)).alias("bit")).selectExpr("bit div 64 as word", "shiftleft(1L, cast(bit % 64 as int)) as flag")
    found = flagged.groupBy("word").agg(F.bit_or("flag").alias("flags")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["flags"].to_numpy(np.int64).view(np.uint64)
    return out


def listing(words: int, needed: np.ndarray):
    """Texts that pass the filter to (text_key, shingles), each text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            key = batch.column("text_key").to_numpy(zero_copy_only=False)
            bit = (key % FILTER_BITS).astype(np.uint64)
            through = (needed[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            for k in np.flatnonzero(through):
                through[k] = int(key[k]) not in seen
                seen.add(int(key[k]))
            for part in tk.slices(batch.filter(pa.array(through)), "text"):
                block = tk.string_block(part.column("text"))
                text, token = shingles(block, words)
                yield pa.RecordBatch.from_arrays([part.column("text_key"), lists(token, np.bincount(text, minlength=block.n))], ["text_key", "shingles"])

    return run


def whole_sets(spark: SparkSession, texts: DataFrame, heads: DataFrame, points: DataFrame, words: int) -> DataFrame:
    """(point, shingles) of the points, from the texts that stand for them."""
    wanted = tk.materialize(spark, heads.join(points, "point", "left_semi").select("point", "text_key"), "wanted")
    found = texts.mapInArrow(listing(words, needed_filter(wanted)), "text_key long, shingles array<long>").dropDuplicates(["text_key"])
    sets = tk.materialize(spark, wanted.join(found, "text_key").select("point", "shingles"), "sets")
    tk.discard(spark, wanted)
    return sets


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with common, the size of the intersection of their whole sets."""
    first, second = (sets.select(F.col("point").alias(f"id_{k}"), F.col("shingles").alias(f"s_{k}")) for k in "ab")
    both = pairs.join(first, F.col("a") == F.col("id_a")).join(second, F.col("b") == F.col("id_b"))
    return both.withColumn("common", F.size(F.array_intersect("s_a", "s_b")).cast("long")).drop("s_a", "s_b", "id_a", "id_b")


def near(percent: int) -> str:
    return f"100 * common >= {percent} * (n_a + n_b - common)"


def unjoined(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Those pairs (a, b, ..) that no chain of links joins."""
    sides = (component.select(F.col("id").alias(f"id_{k}"), F.col("component").alias(f"component_{k}")) for k in "ab")
    for k, side in zip("ab", sides, strict=True):
        pairs = pairs.join(side, F.col(k) == F.col(f"id_{k}"), "left").withColumn(f"component_{k}", F.coalesce(f"component_{k}", k)).drop(f"id_{k}")
    return pairs.where("component_a <> component_b").drop("component_a", "component_b")


def candidates(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, met): pairs of small regions that can be near. Beyond what they share in their prefixes, met
    in small regions and at most the fewer large regions of the two, they share no more than one of them has left."""
    met = regions.where("b is not null").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("met"))
    large = regions.where("b is null").groupBy("a").agg(F.count("*").alias("large"))
    for k in "ab":
        side = large.select(F.col("a").alias("id"), F.col("large").alias(f"large_{k}"))
        met = met.join(side, F.col(k) == F.col("id"), "left").drop("id")
    shared = "met + least(coalesce(large_a, 0), coalesce(large_b, 0))"
    left = f"ceil({percent} * greatest(n_a, n_b) / 100D) - 1"
    return met.where(f"(100 + {percent}) * ({shared} + {left}) >= {percent} * (n_a + n_b)").drop("large_a", "large_b")


def regions_of(spark: SparkSession, heads: DataFrame, percent: int) -> DataFrame:
    rows = heads.select(F.posexplode("prefix").alias("place", "region"), "point", "n").select("region", "point", "n", "place")
    ordered = rows.repartition("region").sortWithinPartitions("region", "point")
    return tk.materialize(spark, ordered.mapInArrow(meeting(percent), REGIONS), "regions")


def linked_points(spark: SparkSession, texts: DataFrame, heads: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of all points that have a link."""
    regions = regions_of(spark, heads, percent)
    pairs = tk.materialize(spark, candidates(regions, percent), "pairs")
    cells = regions.where("b is null").select(F.col("region").alias("cell"), F.col("a").alias("point"), F.col("n_a").alias("n"), "place")
    points = pairs.select(F.col("a").alias("point")).unionByName(pairs.select(F.col("b").alias("point"))).unionByName(cells.select("point")).distinct()
    sets = whole_sets(spark, texts, heads, points, words)
    # First each point's best partner, then the pairs that the links so far do not join.
    best = pairs.groupBy("b").agg(F.max_by(F.struct("a", "n_a", "n_b"), F.struct("met", "a")).alias("x")).select("x.a", "b", "x.n_a", "x.n_b")
    links = tk.materialize(spark, measured(best, sets).where(near(percent)).select("a", "b"), "links")
    component = connected_components(spark, links)
    more = tk.materialize(spark, measured(unjoined(pairs, component), sets).where(near(percent)).select("a", "b"), "links")
    component = joined_components(spark, component, more)
    tk.discard(spark, pairs, links, more)
    found = voronoi(spark, cells, component, sets, percent)
    tk.discard(spark, regions, sets)
    return found


def voronoi(spark: SparkSession, cells: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """component with the links inside of cells (cell, point, n, place): Voronoi regions of pivots, recursively."""
    reach = (100 - percent) / 100 + 1e-9
    rest = cells.withColumns({"home": F.lit(True), "before": F.lit(None).cast("long")})
    written = None
    for turn in range(1 << 30):
        # A region whose points are all in one component has nothing left to find.
        held = rest.join(component.withColumnRenamed("id", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
        parts = held.groupBy("cell", "component").agg(F.count("*").alias("c")).groupBy("cell")
        parts = parts.agg(F.sum("c").alias("points"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max_by("component", F.struct("c", "component")).alias("main"))
        parts = parts.where("same < points * points").selectExpr("cell", "points", "main", "(points - same / points) / 2 as pairs_each")
        held = held.join(parts, "cell").withColumn("split", F.expr(f"pairs_each > {LEAF} and (before is null or points <= {PARTED} * before)"))
        held = tk.materialize(spark, held, "cells")
        tk.discard(spark, written)
        found = tk.materialize(spark, measured(leaf_pairs(held.where("not split"), percent), sets).where(near(percent)).select("a", "b"), "links")
        component = joined_components(spark, component, found)
        split = held.where("split")
        if split.isEmpty():
            tk.discard(spark, held, found)
            return component
        assigned = tk.materialize(spark, distances(split, sets, turn), "distances")
        links = assigned.where(near(percent)).select(F.col("point").alias("a"), F.col("pivot").alias("b")).where("a <> b").distinct()
        component = joined_components(spark, component, links)
        choice = F.struct("distance", "pivot")
        nearest = assigned.groupBy("cell", "point").agg(F.min(choice).alias("least"))
        moved = assigned.join(nearest, ["cell", "point"]).where(f"distance <= least.distance + {2 * reach}")
        moved = moved.select(F.xxhash64("cell", "pivot").alias("cell"), "point", "n", "place", (F.col("home") & (F.col("pivot") == F.col("least.pivot"))).alias("home"), F.col("points").alias("before"))
        rest = written = tk.materialize(spark, moved, "moved")
        tk.discard(spark, held, found, assigned)


def distances(split: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """(cell, point, n, place, home, points, pivot, n_a, n_b, common, distance): each point of a cell and each of its pivots.
    The first pivot is a point in the middle, with least before what the cell shares; the others are chosen by
    hashes of the points alone, so cells of the same points mostly share them."""
    key = F.xxhash64(F.lit(turn), "point")
    middle = F.min(F.struct(F.col("place").cast("long").alias("order"), key.alias("key"), "point", "n"))
    others = (F.min(F.when(F.pmod(key, F.lit(PIVOTS)) == k, F.struct(F.lit(0).cast("long").alias("order"), key.alias("key"), "point", "n"))) for k in range(1, PIVOTS))
    pivots = split.groupBy("cell").agg(F.array(middle, *others).alias("x")).select("cell", F.explode("x").alias("x")).where("x is not null")
    pivots = pivots.select("cell", F.col("x.point").alias("pivot"), F.col("x.n").alias("n_b")).distinct()
    rows = split.select("cell", "point", "n", "place", "home", "points").join(pivots, "cell")
    pairs = rows.select(F.col("point").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("n_a"), "n_b").where("a <> b").distinct()
    common = measured(pairs, sets).select(F.col("a").alias("point"), F.col("b").alias("pivot"), "common")
    rows = rows.join(common, ["point", "pivot"], "left").withColumn("n_a", F.col("n")).withColumn("common", F.coalesce("common", "n"))
    return rows.withColumn("distance", F.expr("1 - common / (n_a + n_b - common)"))


def leaf_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Pairs of cells that links do not join: points outside of the largest component meet all, in blocks of BLOCK.

    Two points that share nothing before the cell's shingle share no more than either has from there on (those that
    do share something earlier meet there); what that rules out never leaves the join."""
    blocks = F.expr(f"cast(1 + points div {BLOCK} as int)")
    columns = ("point", "n", "place", "home", "component")
    a, b = (held.select("cell", "main", blocks.alias("blocks"), *(F.col(c).alias(f"{c}_{k}") for c in columns)) for k in "ab")
    a = a.where("component_a <> main").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    b = b.withColumn("block", F.expr("cast(pmod(xxhash64(point_b), blocks) as int)")).drop("blocks", "main").withColumnsRenamed({"cell": "cell_b", "block": "block_b"})
    new = "(home_a or home_b) and component_a <> component_b and (component_b = main or point_a < point_b)"
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and (100 + {percent}) * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
    met = a.join(b, (a["cell"] == b["cell_b"]) & (a["block"] == b["block_b"]) & F.expr(new) & F.expr(fits))
    return met.select(F.least("point_a", "point_b").alias("a"), F.greatest("point_a", "point_b").alias("b"), F.expr("if(point_a < point_b, n_a, n_b)").alias("n_a"), F.expr("if(point_a < point_b, n_b, n_a)").alias("n_b")).distinct()


def near_points(spark: SparkSession, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, point, component) of every document; component is a point, null without shingles.

    Documents are told apart by a hash of the text; ids, which can be null or repeat, only name what comes out."""
    texts = tk.only(documents, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    low = lowest(percent)
    frequent = frequent_shingles(spark, texts, words, low, beyond=False)
    first = tk.materialize(spark, texts.mapInArrow(pointing(words, percent, frequent, low, last=False), POINTS), "points")
    rest = first.where("rest is not null").select("doc_id", F.col("rest").alias("text"), "text_key")
    frequent = frequent.joined(frequent_shingles(spark, rest, words, low, beyond=True))
    second = tk.materialize(spark, rest.mapInArrow(pointing(words, percent, frequent, low, last=True), POINTS), "points")
    points = first.where("rest is null").unionByName(second).drop("rest")
    heads = points.where("n > 0").groupBy("point").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    heads = tk.materialize(spark, heads, "heads")
    component = linked_points(spark, texts, heads, words, percent)
    found = points.select("doc_id", "text_key", "n", "point").join(component.withColumnRenamed("id", "point"), "point", "left")
    found = found.withColumn("component", F.expr("if(n > 0, coalesce(component, point), null)"))
    found = tk.materialize(spark, found, "found")
    tk.discard(spark, first, second, heads, component)
    return found


def near_classes(spark: SparkSession, documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document (doc_id, text)."""
    found = near_points(spark, documents, words, percent)
    there = found.where("n > 0").groupBy("component", "point").agg(F.min("doc_id").alias("class_id"))
    there = there.join(there.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("point", "class_id", "component_id")
    found = found.join(there, "point", "left")
    ids = (F.expr(f"if(n > 0, {c}, doc_id)").alias(c) for c in ("class_id", "component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), *ids)


def near_filter(spark: SparkSession, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """documents of which one stays of each component: the one of the smallest id; those without words stay."""
    found = near_points(spark, documents, words, percent)
    full = found.where("n > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    kept = full.groupBy("component").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_key")
    repeated = same_rows(full.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies")).where("copies > 1"), kept, "left_semi")
    repeated = tk.materialize(spark, repeated.select("doc_id", "text_key"), "repeated")
    columns = F.struct(*(documents[c] for c in documents.columns))
    keyed = documents.select(columns.alias("row"), documents["doc_id"], F.xxhash64(documents["text"]).alias("text_key"))
    wordless = found.where("n = 0").select("doc_id", "text_key").distinct()
    once = same_rows(kept, repeated, "left_anti").unionByName(wordless)
    out = same_rows(keyed, once, "left_semi")
    if not repeated.isEmpty():
        out = out.unionByName(same_rows(keyed, repeated, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.select("row.*")


def same_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.join(right, left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"]), how)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(spark, tk.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


ORACLE = """
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from words)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * common >= 85 * (s.n + t.n - common)),
edges as (select x, y from links union select y, x from links),
reach(root, node) as (select doc_id, doc_id from sizes union select r.root, e.y from reach r join edges e on e.x = r.node),
lowest as (select node, min(root) as low from reach group by node)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, coalesce(l.low, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join lowest l on l.node = d.doc_id
"""
