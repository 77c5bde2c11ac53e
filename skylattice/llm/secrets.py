"""Secret scans behind a trigram inverted index, in DataFrame operations only.

Every rule's regular expression is read once on the driver for the trigrams that each match must
contain, as an OR of ANDs over ASCII-folded text. Documents post the trigrams that the rules name;
the postings of a clause are intersected per document, and a rule is verified only on documents
that satisfy one of its clauses. A rule without a mandatory trigram scans every document.

Verification splits a text by the rule: the lengths of the pieces and matches, summed in order,
are the spans in code points. Matches of one rule are leftmost and don't overlap; rules are
independent of each other.

Defined results: a null text is the empty text and has no spans; rows that repeat an id are
scanned one by one; rows without an id are
verified by every rule, as postings can't name them; further columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.!*-]{1,64}@"),
)
BASE_KINDS = 3
SPANS = "array<struct<start:bigint,rule:int,end:bigint>>"
Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])
MOST_STRINGS, MOST_CLAUSES, MOST_CLASS = 64, 64, 8


def least_clauses(clauses: Clauses) -> Clauses:
    """Without clauses that another implies; no clause at all if they are too many to be worth it."""
    kept = frozenset(c for c in clauses if not any(other < c for other in clauses))
    return kept if len(kept) <= MOST_CLAUSES else ANY


def both(a: Clauses, b: Clauses) -> Clauses:
    return least_clauses(frozenset(x | y for x in a for y in b))


def of_strings(strings: frozenset[str]) -> Clauses:
    return least_clauses(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def class_members(items: list) -> frozenset[str] | None:
    members: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            members.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST_CLASS:
            members |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(members) if len(members) <= MOST_CLASS else None


def node_strings(op, value) -> tuple[frozenset[str] | None, Clauses]:
    """The strings that a node matches, if few, and what any text with a match of it must contain."""
    if op is sre.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is sre.IN:
        return class_members(value), ANY
    if op is sre.SUBPATTERN:
        return sequence_strings(value[-1])
    if op is sre.BRANCH:
        parts = [sequence_strings(x) for x in value[1]]
        exact = None if any(e is None for e, _ in parts) else frozenset().union(*(e for e, _ in parts))
        needs = least_clauses(frozenset().union(*(q if e is None else of_strings(e) for e, q in parts)))
        return exact, needs
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        exact, needs = sequence_strings(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, ANY
        if exact is not None and low == high and len(exact) == 1:
            return frozenset([next(iter(exact)) * low]), ANY
        return None, ANY if low == 0 else needs if exact is None else of_strings(exact)
    return None, ANY


def sequence_strings(nodes) -> tuple[frozenset[str] | None, Clauses]:
    run, needs, whole = frozenset([""]), ANY, True
    for op, value in nodes:
        exact, own = node_strings(op, value)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in exact)
            continue
        needs, whole = both(both(needs, of_strings(run)), own), False
        run = exact if exact is not None else frozenset([""])
    return (run, ANY) if whole else (None, both(needs, of_strings(run)))


def trigram_query(pattern: str) -> Clauses:
    """Clauses of trigrams of which each text with a match contains one whole, ASCII case aside."""
    exact, needs = sequence_strings(regex_parser.parse(pattern))
    return needs if exact is None else of_strings(exact)


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram) of each of the trigrams that a text contains."""
    low = documents.select("doc_id", F.lower("text").alias("low"))
    found = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(spark: SparkSession, documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, rules): a bit for each indexed rule of which a clause holds; the clause table is as small as the rules."""
    rows = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if frozenset() not in query:
            for c, clause in enumerate(sorted(map(sorted, query))):
                rows += [(r, c, t, 1 << k, (1 << len(clause)) - 1) for k, t in enumerate(clause)]
    if not rows:
        return None
    clauses = spark.createDataFrame(rows, "rule int, clause int, trigram string, bit bigint, whole bigint")
    hits = postings(documents, sorted({x[2] for x in rows})).join(F.broadcast(clauses), "trigram")
    met = hits.groupBy("doc_id", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole")).where("bits = whole")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def rule_matches(rule: Rule, number: int) -> Column:
    """One struct for each match in text: what stands before it, its own length, and whether it counts."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    return F.zip_with(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), whole.alias("whole")),
        group,
        lambda a, g: F.struct(
            F.lit(number).alias("rule"),
            F.char_length(a["before"]).cast("bigint").alias("before"),
            F.char_length(a["whole"]).cast("bigint").alias("length"),
            (F.char_length(g) >= rule.least).alias("counts"),
        ),
    )


def numbered(documents: DataFrame) -> DataFrame:
    """With text never null and row_no, which tells rows of one id apart."""
    texts = documents.withColumn("text", F.coalesce("text", F.lit("")))
    return texts.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))


def scan_secrets(spark: SparkSession, documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, row_no, spans) of every row of documents: (start, rule, end) of each secret, sorted."""
    texts = tk.only(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    found = candidates(spark, texts, rules)
    if found is None:
        marked = texts.withColumn("rules", F.lit(None).cast("bigint"))
    else:
        found = found.withColumnRenamed("doc_id", "id")
        marked = texts.join(found, F.col("doc_id") == F.col("id"), "left").drop("id")
    none = F.array().cast("array<struct<rule:int,before:bigint,length:bigint,counts:boolean>>")

    def on(k: int) -> Column:
        indexed = frozenset() not in trigram_query(rules[k].pattern)
        met = F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        wanted = met | F.col("doc_id").isNull() if indexed else F.rlike("text", F.lit(rules[k].pattern))
        return F.when(wanted, F.filter(rule_matches(rules[k], k), lambda x: x["length"].isNotNull())).otherwise(none)

    each = numbered(marked).select("doc_id", "row_no", F.posexplode_outer(F.concat(*map(on, range(len(rules))))).alias("at", "m"))
    place = Window.partitionBy("doc_id", "row_no", "m.rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.before") + F.col("m.length")).over(place))
    span = F.when(F.col("m.counts"), F.struct((F.col("end") - F.col("m.length")).alias("start"), F.col("m.rule").alias("rule"), "end"))
    return each.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def redact_secrets(spark: SparkSession, documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """documents with every secret replaced by the mark; spans that touch or overlap get one mark."""
    spans = scan_secrets(spark, documents, rules).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("id"), F.col("row_no").alias("number"), "spans")
    others = F.struct(*(documents[c] for c in documents.columns if c != "text"))
    whole = documents.select("doc_id", "text", others.alias("whole"))
    rows = numbered(whole).join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_no") == F.col("number")), "left")

    def piece(s: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("spans", 1, i), F.lit(0).cast("bigint"), lambda m, x: F.greatest(m, x["end"]))
        text = F.when(s["start"] > before, F.substring(F.col("text"), (before + 1).cast("int"), (s["start"] - before).cast("int"))).otherwise("")
        return F.concat(text, F.when((s["start"] > before) | (i == 0), F.lit(mark)).otherwise(""))

    last = F.aggregate("spans", F.lit(0).cast("bigint"), lambda m, x: F.greatest(m, x["end"]))
    rest = F.expr("substring(text, cast(last_end + 1 as int))")
    cut = F.concat(F.array_join(F.transform("spans", piece), ""), rest)
    rows = rows.withColumn("last_end", last).withColumn("clean", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut))
    return rows.select(*(F.col("clean").alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in documents.columns))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def spans_of(rule: int) -> Column:
    return F.filter("spans", lambda s: s["rule"] == rule)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, tk.table(spark, sf_dir, "documents"))
    counts = [F.size(spans_of(k)).cast("bigint").alias(f"n_{RULES[k].kind}") for k in range(BASE_KINDS)]
    base = joined(F.filter("spans", lambda s: s["rule"] < BASE_KINDS), RULES)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans"), RULES).alias("spans"))


def oracle_spans() -> str:
    """SQL for (doc_id, rule, kind, a, b): the spans of every rule, without an index."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  select doc_id, {k} as rule, '{rule.kind}' as kind, a, a + length(m[i]) as b from (
    select doc_id, m, g, i, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as a
    from (select doc_id, m, g, p, unnest(range(1, len(m) + 1)) as i from (
      select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {rule.group}) as g, regexp_split_to_array(t, '{pattern}') as p from texts)))
  where length(g[i]) >= {rule.least}""")
    return " union all ".join(parts)


ORACLE = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
spans as ({oracle_spans()}),
grouped as (
  select doc_id, count(*) filter (rule = 0) as n_assign, count(*) filter (rule = 1) as n_access, count(*) filter (rule = 2) as n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, rule) filter (rule < {BASE_KINDS}), '') as base,
    string_agg(kind || ':' || a || ':' || b, ',' order by a, rule) as spans
  from spans group by doc_id)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access,
  cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts d left join grouped g on d.doc_id = g.doc_id
"""
