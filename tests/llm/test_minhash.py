"""MinHash near duplicates against brute force over whole sets: groups, chains, hubs, crowds that do not link, odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, point string, kept int"


def shingle_set(text: str | None, words: int = 3) -> set:
    w = WORD.findall((text or "").translate(FOLD))
    return set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def expected(rows: list[tuple], words: int = 3, percent: int = 85) -> list[tuple]:
    """By all pairs; rows are nodes, null ids are never the smallest of others."""
    sets = [shingle_set(t, words) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest: dict[int, int | None] = {}
    for i, (doc, *_) in enumerate(rows):
        ids = [x for x in (lowest.get(find(i)), doc) if x is not None]
        lowest[find(i)] = min(ids) if ids else None
    return sorted(((doc, len(sets[i]), lowest[find(i)], doc == lowest[find(i)]) for i, (doc, *_) in enumerate(rows)), key=repr)


def edited(rng, words: list[str], changes: int) -> str:
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bases = [[word() for _ in range(rng.choice([60, 100, 150]))] for _ in range(8)]
    texts = [" ".join(b) for b in bases]
    texts += [edited(rng, b, k) for b in bases for k in (0, 1, 1, 2, 3, 4, 6)]
    chain = bases[0]
    for _ in range(12):  # each is near the one before only
        chain = edited(rng, chain, 1).split()
        texts.append(" ".join(chain))
    crowd = [word() for _ in range(120)]
    texts += [edited(rng, crowd, 2) for _ in range(60)]  # near the base, mostly not near each other
    texts += [edited(rng, bases[3], 5) for _ in range(40)]  # hardly any near
    passage = " ".join(bases[5][:50])
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(30)]
    texts += ["", None, " \t\n", "one", "One", "one two", "one  two", "ONE TWO three", "one two three", "a b c " * 200, "a b c " * 300, "é È x y z", "x" * 3000, texts[0], texts[0].upper(), " ".join(word() for _ in range(20000))]
    rows = [(i, t, 1, "p", 2) for i, t in enumerate(texts)]
    return [*rows, (None, texts[1], 0, "", 0), (None, "alone and null and so on", 0, "", 0), (3, texts[40], 0, "", 0), (7, "another text of a repeated id", 0, "", 0)]


ROWS = corpus()


@pytest.mark.parametrize(("stars", "block"), [(minhash.STARS, minhash.BLOCK), (0, 2)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, stars, block):
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "BLOCK", block)
    found = minhash.near_duplicates(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(ROWS)


def test_other_words_and_limits(spark):
    found = minhash.near_duplicates(spark, spark.createDataFrame(ROWS, SCHEMA), 5, 90).collect()
    assert sorted((tuple(r) for r in found), key=repr) == expected(ROWS, 5, 90)
    with pytest.raises(ValueError, match="85"):
        minhash.near_duplicates(spark, spark.createDataFrame(ROWS, SCHEMA), 5, 80)


def test_tables_of_one_kind(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(spark, nothing).collect() == []
    for rows in ([(1, None, 0, "", 0), (2, "", 0, "", 0)], [(1, "a b c d", 0, "", 0), (2, "e f g h", 0, "", 0)], [(5, "a b c d", 0, "", 0), (5, "a b c d", 0, "", 0), (9, "A b c d", 0, "", 0)]):
        assert sorted((tuple(r) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == expected(rows)


def test_signatures_estimate_similarity_and_sketches_keep_links():
    """Minima agree as often as sets are alike; of many pairs at the limit none is lost by bands or sketches."""
    rng = np.random.default_rng(8)
    pairs, lost = 300, 0
    agreed = []
    for _ in range(pairs):
        tokens = rng.integers(0, 2**64, 120, np.uint64)
        first, second = tokens[:111], np.concatenate([tokens[:102], tokens[111:]])  # 102 of 120 shared
        signature = minhash.minima(np.concatenate([first, second]), np.array([0, 111]), minhash.HASHES)
        agreed.append((signature[:, 0] == signature[:, 1]).mean())
        buckets, sketch = minhash.buckets_of(signature), minhash.sketch_of(signature)
        apart = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
        lost += not (buckets[0] == buckets[1]).any() or apart > minhash.MOST_APART
        fine = minhash.sketch_of(minhash.minima(np.concatenate([first, second]), np.array([0, 111]), minhash.FINE, 12))
        lost += int(np.bitwise_count(fine[0] ^ fine[1]).sum()) > minhash.FINE_APART
    assert lost == 0 and abs(np.mean(agreed) - 0.85) < 0.01 and 0.015 < np.std(agreed) < 0.025


def test_stars_join_chains_hubs_and_cycles(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(1000, 1300)]
    cycle = [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    joined = [(1299, 160), (7, 7), (None, 3), (9, None)]
    links = chain + hub + cycle + joined
    links = [pair if rng.random() < 0.5 else pair[::-1] for pair in links] + chain[:5]
    found = {r["id"]: r["component"] for r in minhash.star_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 5 for i in [*range(100, 161), 5, *range(1000, 1300)]} | {200 + i: 200 for i in range(30)}
    assert minhash.star_components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_signing_is_the_same_in_any_batch(spark):
    texts = [t for _, t, *_ in ROWS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(range(len(texts)))], ["doc_id", "text", "text_key"])
    whole = pa.Table.from_batches(list(minhash.signing(3)(iter([batch])))).to_pylist()
    alone = [r for k in range(len(texts)) for r in pa.Table.from_batches(list(minhash.signing(3)(iter([batch.slice(k, 1)])))).to_pylist()]
    assert [r["point"] for r in whole] == [r["point"] for r in alone]
    first = {}
    for r in alone:
        first.setdefault(r["point"], r)
    assert all(r["buckets"] in ([], first[r["point"]]["buckets"]) and r["sketch"] in ([], first[r["point"]]["sketch"]) for r in whole)


def test_query_and_sql_agree(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    theirs = con.sql(f"select doc_id, n_shingles, component_id, kept from ({minhash.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in minhash.op11_minhash_near_dedup(spark, sf).collect()) == sorted(theirs)


def test_a_crowd_lists_no_pairs():
    """300 sets, all pairs alike and many of them links: a block gives fewer links than points, with the components of all pairs."""
    rng = np.random.default_rng(5)
    core = rng.integers(-(2**63), 2**63, 400)
    sets = [np.concatenate([rng.permutation(core)[: 400 - 20 - k % 26], rng.integers(-(2**63), 2**63, 3)]) for k in range(300)]
    fine = [minhash.sketch_of(minhash.minima(s.view(np.uint64), np.array([0]), minhash.FINE, 12))[0].tobytes() for s in sets]
    outer = [True] * 300 + [False] * 300
    columns = {"key": [1] * 600, "bucket": [7] * 600, "outer": outer, "point": [*range(300)] * 2, "n": [len(s) for s in sets] * 2, "component": [*range(300)] * 2, "main": [299] * 600}
    kinds = dict.fromkeys(columns, pa.int64()) | {"outer": pa.bool_()}
    rows = pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()} | {"fine": pa.array(fine * 2, pa.binary()), "own": pa.array([[7] * minhash.BANDS] * 600, pa.list_(pa.int64())), "shingles": pa.array([s.tolist() for s in sets] * 2, pa.list_(pa.int64()))})
    rows = rows.filter(pa.array([not o or k != 299 for k, o in zip([*range(300)] * 2, outer, strict=True)]))
    both = [(x, y) for x in range(300) for y in range(x)]
    linked = [(x, y) for x, y in both if 100 * (c := len(np.intersect1d(sets[x], sets[y]))) >= 85 * (len(sets[x]) + len(sets[y]) - c)]
    batches = [b for k in range(0, len(rows), 97) for b in rows.slice(k, 97).to_batches()]
    marked = pa.Table.from_batches(list(minhash.comparing(85)(iter(batches))))
    links = pa.Table.from_batches(list(minhash.linking(85)(iter(batches)))).to_pylist()
    assert len(linked) > 5_000 and sum(len(x) for x, _ in minhash.block_pairs(rows, 85)) > 30_000
    assert len(marked) <= len(rows) and len(links) < 300 and all(tuple(sorted((r["a"], r["b"]), reverse=True)) in set(linked) for r in links)

    def parts(pairs) -> set:
        root = list(range(300))
        for x, y in pairs:
            root = [root[x] if r == root[y] else r for r in root]
        return {frozenset(k for k in range(300) if root[k] == r) for r in root}

    assert parts((r["a"], r["b"]) for r in links) == parts(linked)
