"""Near duplicates by MinHash: universal hash minima, bands, verified signatures, confirmed sets, components.

Each text's word-shingle set is hashed by HASHES = BANDS x ROWS functions a x + b modulo 2**64 whose minima
are its signature. Two sets of similarity J agree on a minimum with probability J, and on all ROWS of some
band with 1 - (1 - J**ROWS)**BANDS: a link at the limit of 0.85 meets in no band with probability 9e-9. One bit
of every minimum stays as a sketch, 6 longs; pairs whose sketches differ in more than MOST_APART bits, as a
link's do with probability 4e-8, go no further. The sets of the others are compared whole.

Points are distinct sets. Buckets of two points or more are kept; nothing ever lists all pairs of one. In STARS
turns each bucket whose points links have not joined yet chooses a pivot in its largest component, and every
point outside is compared with the pivot it meets in most buckets: one pair for each point and turn. What is
left, points outside of their bucket's largest component, then meets the bucket's points of other components,
in blocks of BLOCK: the sets of these points get FINE further minima, a bit of each, and a task compares those of a
block at once. A pair counts, in the first bucket that it shares, only if they differ in FINE_APART bits at most, which
a link does not with probability 1e-9. Points with such a pair get their whole sets and meet again in their blocks: there pairs that
no link of the block has joined yet are confirmed, and only links that join come out, fewer than the block has points. So
no pairs are listed, however many points are alike. Links become components by alternating large-star and small-star steps.

Defined results: a null or wordless text has no shingles and is alone; fewer words than a shingle make one
shingle of the whole sequence; words are lower-cased in ASCII; shingles are told by 64 bits of hashes, equal
sets by 64 of theirs. Rows that repeat an id are documents of their own; null ids are never the smallest of a
component that has others, and are kept where they are alone. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .jaccard import lists, measured, near, shingles, whole_sets

WORDS, PERCENT = 3, 85
BANDS, ROWS = 48, 7
HASHES = BANDS * ROWS
#: Differing bits of two sketches beyond which a pair is no link: 6 standard deviations over what J = 0.85 has.
MOST_APART = 54
SKETCH = -(-HASHES // 64)
#: Further minima of points that are hard to tell, and the bits that two of them may differ in: 6 standard deviations again.
FINE, FINE_APART = 3072, 318
#: Words of sketches that a task compares at once; shingles that it hashes at once.
COMPARED, HASHED = 2_000_000, 80_000
#: Layout only: turns of pivots before the rest is compared; points of a block of a bucket, and shingles of them.
STARS, BLOCK, BLOCK_SHINGLES = 3, 4096, 4_000_000
SIGNED = "doc_id long, text_key long, point long, n long, buckets array<long>, sketch array<long>"
MET = "key long, bucket long, outer boolean, point long, n long, component long, main long"


def functions(hashes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the hash functions, the same everywhere."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, hashes, np.uint64)


def minima(token: np.ndarray, starts: np.ndarray, hashes: int, seed: int = 11) -> np.ndarray:
    """hashes x sets: the least value of every function over each run of tokens that begins at starts."""
    factor, shift = functions(hashes, seed)
    out, h = np.empty((hashes, len(starts)), np.uint64), np.empty_like(token)
    for k in range(hashes):
        np.multiply(token, factor[k], out=h)
        np.add(h, shift[k], out=h)
        np.minimum.reduceat(h, starts, out=out[k])
    return out


def buckets_of(signature: np.ndarray) -> np.ndarray:
    """sets x BANDS: a key of each band's minima."""
    rows = signature.reshape(BANDS, ROWS, -1)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], signature.shape[1], 1)
    for k in range(ROWS):
        key = tk.mix(key * np.uint64(tk.BASE) + rows[:, k])
    return key.T


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """sets x longs: a bit of every minimum, 64 in a long."""
    bits = np.zeros((-(-len(signature) // 64) * 64, signature.shape[1]), np.uint8)
    bits[: len(signature)] = (tk.mix(signature) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=0, bitorder="little").T.copy().view(np.uint64)


def signing(words: int):
    """Texts to SIGNED; buckets and sketch of a set come out once a task, and never for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in tk.slices(batch, "text"):
                block = tk.string_block(part.column("text"))
                text, token = shingles(block, words)
                n = np.bincount(text, minlength=block.n)
                edges = np.concatenate([[0], np.cumsum(n)])
                total = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(token + np.uint64(1)), dtype=np.uint64)])
                point = tk.mix((total[edges[1:]] - total[edges[:-1]]) * np.uint64(tk.BASE) + n.astype(np.uint64))
                new = np.zeros(block.n, bool)
                new[np.unique(point, return_index=True)[1]] = True
                new &= n > 0
                for k in np.flatnonzero(new):
                    new[k] = int(point[k]) not in seen
                    seen.add(int(point[k]))
                columns = [np.zeros((block.n, w), np.uint64) for w in (BANDS, SKETCH)]
                if new.any():
                    held = np.repeat(new, n)
                    signature = minima(token[held], np.concatenate([[0], np.cumsum(n[new])[:-1]]), HASHES)
                    columns = [buckets_of(signature), sketch_of(signature)]
                    del signature
                found = [lists(c[: int(new.sum())].ravel(), np.where(new, c.shape[1], 0)) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(point.view(np.int64)), pa.array(n.astype(np.int64)), *found], [x.split()[0] for x in SIGNED.split(", ")])

    return run


def star_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for each id that has one, by large-star and
    small-star steps until no edge changes. Null ends and loops do not count; minima are combined before shuffles."""

    def directed(found: DataFrame) -> DataFrame:
        return found.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def print_of(found: DataFrame) -> tuple:
        return tuple(found.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = tk.materialize(spark, directed(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "stars")
    before = print_of(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.of).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tk.materialize(spark, directed(large), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "of"), large.u == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = tk.materialize(spark, directed(small.unionByName(least.select("u", F.col("m").alias("v")))), "stars")
        tk.discard(spark, edges, large)
        edges, now = small, print_of(small)
        if now == before:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out = out.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
            out.written_to = edges.written_to
            return out
        before = now


def with_links(spark: SparkSession, component: DataFrame, links: DataFrame) -> DataFrame:
    """component after further links: its own stars are edges beside them."""
    if links.isEmpty():
        return component
    stars = component.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    out = star_components(spark, stars.unionByName(links.select("a", "b")))
    tk.discard(spark, component)
    return out


def alike(percent: int, a: str = "a", b: str = "b") -> str:
    """Whether sizes and sketches of a pair allow a link."""
    apart = " + ".join(f"bit_count(sketch_{a}[{k}] ^ sketch_{b}[{k}])" for k in range(SKETCH))
    return f"100 * least(n_{a}, n_{b}) >= {percent} * greatest(n_{a}, n_{b}) and {apart} <= {MOST_APART}"


def open_rows(spark: SparkSession, crowds: DataFrame, component: DataFrame) -> DataFrame:
    """crowds with components, of the buckets whose points are not all in one; main: the largest of the bucket, of `points` points with `shingles`."""
    held = crowds.join(component.withColumnRenamed("id", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    parts = held.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("bucket")
    parts = parts.agg(F.sum("c").alias("points"), F.sum("s").alias("shingles"), F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main")).where("parts > 1")
    return tk.materialize(spark, held.join(parts.drop("parts"), "bucket"), "open")


def star_pairs(held: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): each point outside of its buckets' largest components and, of the pivots it may be near, the one it meets most."""
    pivot = F.min_by(F.struct("point", "n", "sketch"), F.xxhash64(F.lit(turn), "point")).alias("p")
    pivots = held.where("component = main").groupBy("bucket").agg(pivot)
    pivots = pivots.select("bucket", F.col("p.point").alias("b"), F.col("p.n").alias("n_b"), F.col("p.sketch").alias("sketch_b"))
    met = held.where("component <> main").select("bucket", F.col("point").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")).join(pivots, "bucket").where(alike(percent))
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("met"))
    return met.groupBy("a").agg(F.max_by(F.struct("b", "n_a", "n_b"), F.struct("met", "b")).alias("x")).select("a", "x.b", "x.n_a", "x.n_b")


def refining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, shingles) to (point, fine): the sketches of FINE further minima, as bytes."""
    for batch in batches:
        column = batch.column("shingles")
        edges = column.offsets.to_numpy()
        token = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        cut = np.append(np.flatnonzero(np.diff((edges[:-1] - edges[0]) // HASHED, prepend=-1)), batch.num_rows) if batch.num_rows else []
        found = [sketch_of(minima(token[edges[i] : edges[j]], edges[i:j] - edges[i], FINE, 12)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array([row.tobytes() for part in found for row in part], pa.binary())], ["point", "fine"])


def block_pairs(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one block that their sizes and fine sketches allow, some at a time: outside (first) with any of another
    component, each pair once, and only in the first bucket that it shares."""
    column = {c: rows.column(c).to_numpy() for c in ("bucket", "outer", "point", "n", "component", "main")}
    fine = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint64).reshape(len(rows), -1)
    buckets = rows.column("own").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    first, second = np.flatnonzero(column["outer"]), np.flatnonzero(~column["outer"])
    band = int(np.argmax(buckets[0] == column["bucket"][0]))
    step = max(1, COMPARED // max(1, len(second) * fine.shape[1]))
    for k in range(0, len(first), step):
        a = first[k : k + step]
        n_a, n_b = column["n"][a][:, None], column["n"][second][None]
        open_ = (column["component"][a][:, None] != column["component"][second][None]) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
        open_ &= (column["component"][second] == column["main"][second])[None] | (column["point"][a][:, None] < column["point"][second][None])
        i, j = np.nonzero(open_)
        i, j = a[i], second[j]
        for m in range(0, len(i), max(1, COMPARED // fine.shape[1])):
            x, y = (v[m : m + max(1, COMPARED // fine.shape[1])] for v in (i, j))
            near_ = np.bitwise_count(fine[x] ^ fine[y]).sum(1, dtype=np.int64) <= FINE_APART
            x, y = x[near_], y[near_]
            once = np.argmax(buckets[x] == buckets[y], 1) == band
            yield x[once], y[once]


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, of rows in order of it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        key = rows.column("key").to_numpy()
        cut = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield rows.slice(i, j - i)
        held = rows.slice(int(cut[-1]))
    if held is not None:
        yield held


def comparing(percent: int):
    """Rows of blocks that have a pair in theirs, as MET."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            met = np.zeros(len(rows), bool)
            for x, y in block_pairs(rows, percent):
                met[x] = met[y] = True
            if met.any():
                yield from rows.select([c.split()[0] for c in MET.split(", ")]).filter(pa.array(met)).combine_chunks().to_batches()

    return run


def block_links(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Places of links of one block that join what its components and its links before do not."""
    sets = rows.column("shingles").combine_chunks()
    n = np.diff(sets.offsets.to_numpy())
    ends = np.cumsum(n)
    code = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, joined = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    mine, links = np.zeros(int(code.max(initial=-1)) + 1, bool), []
    for first, second in block_pairs(rows, percent):
        for x in np.unique(first).tolist():
            others = second[first == x]
            others = others[joined[others] != joined[x]]
            if not len(others):
                continue
            mine[code[ends[x] - n[x] : ends[x]]] = True
            starts = np.cumsum(n[others]) - n[others]
            held = code[np.arange(n[others].sum()) + np.repeat(ends[others] - n[others] - starts, n[others])]
            common = np.add.reduceat(mine[held], starts, dtype=np.int64)
            mine[code[ends[x] - n[x] : ends[x]]] = False
            for y in others[100 * common >= percent * (n[x] + n[others] - common)].tolist():
                if joined[y] != joined[x]:
                    joined[joined == joined[y]] = joined[x]
                    links.append((x, y))
    return links


def linking(percent: int):
    """Blocks with whole sets to links (a, b), fewer than they have points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            links = np.array(block_links(rows, percent), np.int64).reshape(-1, 2)
            if len(links):
                point = rows.column("point").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(point[links[:, 0]]), pa.array(point[links[:, 1]])], ["a", "b"])

    return run


def rest_links(spark: SparkSession, held: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join points outside of a bucket's largest component and its points of other components, in blocks."""
    points = held.select("point").distinct()
    fine = sets.join(points, "point", "left_semi").mapInArrow(refining, "point long, fine binary")
    known = tk.materialize(spark, fine.join(heads.select("point", F.col("buckets").alias("own")), "point"), "fine")
    blocks = F.expr(f"cast(1 + greatest(points div {BLOCK}, shingles div {BLOCK_SHINGLES}) as int)").alias("blocks")
    rows = held.select("bucket", "main", "point", "n", "component", blocks).join(known, "point")
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(point), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    sides = [rows.where("component <> main").withColumn("key", F.xxhash64("bucket", "block", "other")), rows.withColumn("key", F.xxhash64("bucket", "other", "block"))]
    both = [df.select("key", "bucket", F.lit(outer).alias("outer"), "point", "n", "component", "main", "fine", "own") for df, outer in zip(sides, (True, False), strict=True)]
    met = both[0].unionByName(both[1]).repartition("key").sortWithinPartitions("key").mapInArrow(comparing(percent), MET)
    met = tk.materialize(spark, met, "met").join(known.join(sets, "point"), "point")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(linking(percent), "a long, b long")


def linked_points(spark: SparkSession, texts: DataFrame, heads: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(id, component) of all points that have a link; None if no point meets another."""
    rows = heads.select(F.explode("buckets").alias("bucket"), "point", "n", "sketch")
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    crowds = tk.materialize(spark, rows.join(crowded, "bucket", "left_semi"), "crowds")
    if crowds.isEmpty():
        tk.discard(spark, crowds)
        return None
    sets = whole_sets(spark, texts, heads, crowds.select("point").distinct(), words)
    component = spark.createDataFrame([], "id long, component long")
    for turn in range(STARS + 1):
        held = open_rows(spark, crowds, component)
        if held.isEmpty():
            tk.discard(spark, held)
            break
        found = measured(star_pairs(held, turn, percent), sets).where(near(percent)).select("a", "b") if turn < STARS else rest_links(spark, held, heads, sets, percent)
        links = tk.materialize(spark, found, "links")
        component = with_links(spark, component, links)
        tk.discard(spark, held, links)
    tk.discard(spark, crowds, sets)
    return component


def near_duplicates(spark: SparkSession, documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document (doc_id, text)."""
    if percent < PERCENT:
        raise ValueError(f"bands and sketches are made for similarities of {PERCENT} % or more")
    texts = tk.only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    points = tk.materialize(spark, texts.mapInArrow(signing(words), SIGNED), "signed")
    heads = points.where("size(buckets) > 0").groupBy("point").agg(F.min("text_key").alias("text_key"), *(F.first(c).alias(c) for c in ("n", "buckets", "sketch")))
    heads = tk.materialize(spark, heads, "heads")
    component = linked_points(spark, texts, heads, words, percent)
    found = points.select("doc_id", "n", "point")
    if component is None:
        found = found.withColumn("component", F.col("point"))
    else:
        found = found.join(component.withColumnRenamed("id", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    lowest = found.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    found = found.join(lowest, "component", "left").withColumn("component_id", F.expr("if(n > 0, lowest, doc_id)"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, tk.table(spark, sf_dir, "documents"))


ORACLE = """
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from words)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * common >= 85 * (s.n + t.n - common)),
edges as (select x, y from links union select y, x from links),
reach(root, node) as (select doc_id, doc_id from sizes union select r.root, e.y from reach r join edges e on e.x = r.node),
lowest as (select node, min(root) as low from reach group by node)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, coalesce(l.low, d.doc_id) as component_id, d.doc_id = coalesce(l.low, d.doc_id) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join lowest l on l.node = d.doc_id
"""
