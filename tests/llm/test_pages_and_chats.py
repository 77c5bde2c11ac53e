"""Extraction, revisits and chats against brute-force versions; queries of the subpackage; the pipeline."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from skylattice.llm import chat, extract, jaccard, packing, quality, secrets, warc
from skylattice.llm import queries as llm_queries


def test_pages_parse_as_html_does():
    p = extract.Page("<div>a<p>b &amp; <b>c<br>d</b><p>e<ul><li>f<li>g</ul><script>x='</p>'</script><!-- no --> h</div><a href='>'>i</a>")
    assert [t for _, t in p.blocks] == ["a", "b & c d", "e", "f", "g", "h", "i"]
    assert [p.tag[k] for k, _ in p.blocks] == ["div", "p", "p", "li", "li", "div", "html"]
    for source in ("", "<", "<p", "<<<>>>", "</p></div>", "<p class='x>y", "&bogus; &#x41;", "<script>never closed", "<!-- never closed", "<div " * 500, '<a b="' * 300):
        extract.Page(source)
    assert [t for _, t in extract.Page("1 < 2 & 3 > 2").blocks] == ["1 < 2 & 3 > 2"]


def test_decoding_keeps_rooted_subtrees():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 9
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, n))])
        odds, own = rng.normal(0, 2, n), rng.integers(0, 60, n).astype(float)
        kept = extract.decode(parent, odds, own)
        weight = odds * (0.25 + np.log1p(own))
        assert all(kept[parent[i]] for i in range(1, n) if kept[i])
        best = max(sum(w if f else -w for w, f in zip(weight, flags, strict=True)) for flags in ([bool(m >> k & 1) for k in range(n)] for m in range(1 << n)) if flags[0] and all(flags[parent[i]] for i in range(1, n) if flags[i]))
        assert sum(w if f else -w for w, f in zip(weight, kept, strict=True)) == pytest.approx(best)


def test_raw_elements_end_where_the_source_says():
    p = extract.Page("<p>" + "İ" * 40 + "</p><script>x</SCRIPT><p>hello first</p><title>t</title><p>a <math>x<mo>+</mo>y</math> <svg><text>z</text></svg><noscript>n</noscript></p><p>second</p>")
    assert [t for _, t in p.blocks] == ["İ" * 40, "hello first", "a x+y zn", "second"]
    assert [t for _, t in extract.Page("<p>a</p><script>var x = '</scripted>';").blocks] == ["a"]


def test_extraction_finds_articles_it_has_not_seen(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    trees = extract.fit_trees(pages)
    hits = collections.Counter()
    for k, r in enumerate(pages.limit(30).collect()):
        texts = [t for _, t in extract.Page(r["html"]).blocks if len(t) > 40]
        made = extract.MarkedPage(extract.rebuilt(texts, random.Random(9000 + k)))
        rows, own = extract.features(made)
        import numpy as np

        kept = extract.decode(np.array(made.parent), trees.odds(rows), own)
        for node, text in made.blocks:
            hits[bool(made.content[node]), bool(kept[node])] += len(text)
    assert hits[True, True] / (hits[True, True] + hits[True, False]) > 0.95
    assert hits[True, True] / (hits[True, True] + hits[False, True]) > 0.95


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None, 0), (2, "u", "", 0), (2, "u", "", 0), (None, None, "<p>only a text of some length here, it is.</p>", 0), (4, "v", "<article><h1>T</h1><p>a&nbsp; b\n c</p></article><nav>x</nav>", 0)]
    got = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    by = {r["page_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert got.count() == 5 and by[1] == by[2] == ("", 0) and by[4] == ("T\n\na b c", 8)
    assert extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chats_keep_maximal_conversations(spark):
    rng = random.Random(1)
    logs = {}
    for k in range(40):
        logs[k] = [(rng.choice(["user", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 5))]
    logs[100] = [("user", "long")] * 3 + [("assistant", "end")]
    logs[101] = logs[100][:2]
    logs[None] = [("user", "no id")]
    rows = [(c, t, r, x, "clash") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += [rows[0], rows[0], (200, None, "user", "turnless", "clash")]
    logs[200] = [("user", "turnless")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string").repartition(3)
    expected = {}
    for c, turns in logs.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in logs.values()):
            continue
        same = [k for k, o in logs.items() if o == turns and k is not None]
        if (min(same) if same else None) == c:
            expected[c] = (len(turns), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in turns))
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.format_chats(df).collect()}
    assert got == expected
    assert chat.format_chats(df.where("false")).count() == 0


def test_revisits_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = {n: rng.choice(["1", "2", 'W/1']) for n in ("etag", "last-modified", "date", "x-own") if rng.random() < 0.6}
        url = rng.choice(["http://A.com/x", "https://www.a.com:443/x/#f", "http://b.org/?ref=1", "http://b.org", None])
        rows.append((k, url, rng.choice([None, *range(0, 400_000, 20_000)]), kind, rng.choice([headers, None]), f"p{k}", "clash"))
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, payload string, full string")
    keys = dict(df.select("record_id", warc.canonical_url(F.col("url"))).collect())
    assert set(keys.values()) == {"a.com/x", "b.org", None}
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for k, _, at, kind, headers, _, _ in rows:
        if kind != "revisit":
            continue
        full = [r for r in rows if r[3] == "response" and r[2] is not None and at is not None and keys[k] is not None and keys[r[0]] == keys[k] and (r[2], r[0]) < (at, k)]
        one = max(full, key=lambda r: (r[2], r[0]), default=None)
        status, own = "no_response", headers or {}
        if one is not None:
            old = one[4] or {}
            tags = [re.sub("^W/", "", h["etag"]) if "etag" in h else None for h in (own, old)]
            agree = tags[0] == tags[1] if None not in tags else own["last-modified"] == old["last-modified"] if "last-modified" in own and "last-modified" in old else None
            status = "no_validator" if agree is None else "resolved" if agree else "mismatch"
        assert got[k]["status"] == status
        merged = {**(one[4] or {}), **{n: v for n, v in own.items() if n in warc.PERMITTED}} if status == "resolved" else {}
        assert got[k]["headers"] == "\n".join(sorted(f"{n}: {v}" for n, v in merged.items()))
        assert (got[k]["response_id"], got[k]["payload"]) == ((one[0], one[5]) if status == "resolved" else (-1, ""))
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_queries_agree_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in llm_queries.ORACLES.items():
        ours = llm_queries.QUERIES[name](spark, sf)
        columns = sorted(ours.columns)
        theirs = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({sql})").fetchall()
        assert sorted(map(repr, theirs)) == sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()), name


def test_pipeline_stages_match_brute_force(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for r in rows:
        w = word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and low[i] != low[j] and 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
        if not changed:
            break
    expected = {i for i in sets if low[i] == i}
    out = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns, name
    found = {r["doc_id"]: r for r in out.collect()}
    assert set(found) == expected
    for r in rows:
        if r["doc_id"] in expected and not any(m for rule in secrets.RULES for m in re.finditer(rule.pattern, r["text"]) if len(m[rule.group]) >= rule.least):
            assert found[r["doc_id"]]["text"] == r["text"]
    packed = pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == expected
    assert max(collections.Counter(r["sequence_id"] for r in packed for _ in range(r["length"])).values()) <= packing.CAPACITY
    assert jaccard.PERCENT == 85 and pipeline.NEAR_PERCENT == 80


def test_pipeline_stages_of_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline as pipeline

    text = " ".join(f"word{k % 70} token{k % 41}" for k in range(90)) + ' api_key = "0123456789abcdef0123"'
    columns = "doc_id long, text string, text_key int, row_no string, spans int, rules int, whole int, point int"
    rows = [(1, text, 1, "a", 2, 3, 4, 5), (1, text, 1, "a", 2, 3, 4, 5), (None, text, 0, "b", 0, 0, 0, 0), (None, text.upper(), 0, "b", 0, 0, 0, 0), (3, None, 0, "c", 0, 0, 0, 0), (4, "", 0, "c", 0, 0, 0, 0), (5, "x" * 9, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    kept = jaccard.near_filter(spark, docs, pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT)
    assert sorted((r["doc_id"], r["row_no"]) for r in kept.collect()) == [(1, "a"), (3, "c"), (4, "c"), (5, None)] and kept.columns == docs.columns
    for table in (docs, docs.where("false")):
        out = table
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == docs.columns, name
        assert all("0123456789abcdef0123" not in (r["text"] or "") for r in out.collect())
        assert pipeline.STAGES[-1][1](spark, out, sf).count() == out.count()
