"""Secret scans with a trigram inverted index, in Spark SQL functions alone.

For every rule a Boolean trigram query is derived from its regular expression:
each way through its alternatives, optional parts and small classes spells
literal runs, all of whose trigrams a match must hold.  The index keeps, per
segment of documents, the posting list of each trigram that some rule asks for
(case-folded).  The lists are intersected within a way and united over the
ways, and only the documents that remain are verified with the rule's regular
expression.  A rule with a way that has no trigram scans every text.

A segment is a hash range of doc_ids of bounded size, so posting lists stay
short however large the table or frequent the trigram; a document's segment
depends on its id alone, whatever its source.

Spans are code points, end exclusive.  Cases: a null text counts as empty and
has no spans.  Rows that repeat a doc_id are verified each on their own text.
Spans of different kinds may overlap.  An empty table gives no rows.  Columns
besides ``doc_id`` and ``text`` are not read by ``scan``; ``redact`` passes
them on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: Documents of a segment of the index, on average.
SEGMENT_DOCS = 4096
#: Characters of a class that are spelt out; larger classes break a literal run.
SMALL_CLASS = 8
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """``group`` of a match has ``least`` code points or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order.  ``[0-9a-f]{24,}`` finds what
#: ``[0-9a-f]+`` of 24 and more finds, as both take whole runs; likewise ``access``.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the scan adds: well-known token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def _ways(parsed) -> list[list[str | None]]:
    """Ways through a parsed pattern: characters, None where anything may be."""
    ways: list[list[str | None]] = [[]]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [[chr(arg).lower()]]
        elif name == "IN":
            chars = [chr(a).lower() for o, a in arg if str(o) == "LITERAL"]
            options = [[c] for c in chars] if len(chars) == len(arg) <= SMALL_CLASS else [[None]]
        elif name == "SUBPATTERN":
            options = _ways(arg[3])
        elif name == "BRANCH":
            options = [w for branch in arg[1] for w in _ways(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, body = arg
            inner = _ways(body)
            if (lo, hi) == (0, 1):
                options = [[], *inner]
            else:
                options = [[*(c for w in p for c in w), None] for p in product(inner, repeat=min(lo, 4))]
        else:
            options = [[None]]
        ways = [a + b for a, b in product(ways, options)]
    unique = {tuple(w): w for w in ways}
    return list(unique.values())


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, of one of which a match holds all; empty if some way
    through the pattern has no trigram."""
    query = []
    for way in _ways(regex_parser.parse(pattern)):
        runs = "".join(c if c is not None else "\0" for c in way).split("\0")
        grams = frozenset(r[k:k + 3] for r in runs for k in range(len(r) - 2))
        if not grams:
            return []
        query.append(grams)
    return list(dict.fromkeys(q for q in query if not any(o < q for o in query)))


def build_index(docs: DataFrame, rules=RULES, segment_docs: int = SEGMENT_DOCS) -> tuple[DataFrame, list[str]]:
    """The inverted index, one row a segment with a posting list (doc_ids) for
    each trigram of the rules' queries, and those trigrams."""
    grams = sorted({g for r in rules for q in trigram_query(r.pattern) for g in q})
    segments = max(1, -(-docs.count() // segment_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower(text_or_empty(docs)).alias("t"))
    lists = [F.collect_set(F.when(F.contains("t", F.lit(g)), F.col("id"))).alias(f"p{k}")
             for k, g in enumerate(grams)]
    index = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(segments)).alias("segment")).agg(F.lit(0).alias("_"), *lists)
    return staged(index.drop("_"), "trigram-index"), grams


def candidates(index: DataFrame, grams: list[str], rules=RULES) -> DataFrame:
    """``_s1_id`` and ``_s1_mask`` (bit k: rule k may match) from the postings."""
    hits = []
    for k, rule in enumerate(rules):
        found = None
        for way in trigram_query(rule.pattern):
            names = [f"p{grams.index(g)}" for g in sorted(way)]
            both = F.col(names[0])
            for name in names[1:]:
                both = F.array_intersect(both, F.col(name))
            found = both if found is None else F.array_union(found, both)
        if found is not None:
            hits.append(_flagged(found, 1 << k))
    if not hits:
        return index.select(F.lit(0).cast("long").alias("_s1_id"), F.lit(0).alias("_s1_mask")).where("false")
    return (index.select(F.explode(F.concat(*hits)).alias("h"))
            .groupBy(F.col("h.id").alias("_s1_id")).agg(F.bit_or("h.bit").alias("_s1_mask")))


def _flagged(ids: Column, bit: int) -> Column:
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(bit).alias("bit")))


def _running(steps: Column, block: int = 256) -> Column:
    """Running sums of an array, block by block so that appending stays cheap."""
    zero = F.lit(0).cast("long")

    def sums(values, base):
        start = F.struct(base.alias("t"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(values, start, lambda s, x: F.struct(
            (s["t"] + x).alias("t"), F.array_append(s["all"], s["t"] + x).alias("all")), lambda s: s["all"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int"))
    part = lambda b: F.slice(steps, b * block + 1, F.lit(block))
    whole = sums(F.transform(numbers, lambda b: F.aggregate(part(b), zero, lambda a, x: a + x)), zero)
    base = lambda b: F.when(b == 0, zero).otherwise(F.get(whole, b - 1))
    inner = F.flatten(F.transform(numbers, lambda b: sums(part(b), base(b))))
    return F.when(F.size(steps) > 0, inner).otherwise(F.array().cast("array<bigint>"))


def _of_kind(found: Column, kind: int, least: int) -> Column:
    kept = F.filter(found, lambda x: F.char_length(x["v"]) >= least)
    return F.transform(kept, lambda x: F.struct(
        (x["e"] - x["n"]).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end")))


def _with_spans(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``_s1_spans``, the spans (start, kind number, end) in order, given
    ``_s1_text`` and ``_s1_mask``."""
    none = F.array().cast("array<string>")
    cols = {}
    for k, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            may = F.col("_s1_mask").bitwiseAND(F.lit(1 << k)) != 0
        else:
            may = F.col("_s1_text").rlike(rule.pattern)
        p = F.lit(rule.pattern)
        cols |= {f"_s1_m{k}": F.when(may, F.regexp_extract_all("_s1_text", p, F.lit(0))).otherwise(none),
                 f"_s1_v{k}": F.when(may, F.regexp_extract_all("_s1_text", p, F.lit(rule.group))).otherwise(none),
                 f"_s1_g{k}": F.when(may, F.split("_s1_text", rule.pattern, -1)).otherwise(none)}
    df = df.withColumns(cols)
    all_spans = []
    for k, rule in enumerate(rules):
        m, v, g = (F.col(f"_s1_{c}{k}") for c in "mvg")
        size = F.transform(m, lambda x: F.char_length(x).cast("long"))
        ends = _running(F.slice(F.zip_with(g, m, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("long")),
                                F.lit(1), F.size(m)))
        spans = _of_kind(F.arrays_zip(ends.alias("e"), size.alias("n"), v.alias("v")), k, rule.least)
        all_spans.append(F.when(F.size(m) > 0, spans).otherwise(F.array().cast(
            "array<struct<start:bigint,kind:int,end:bigint>>")))
    return df.withColumn("_s1_spans", F.array_sort(F.concat(*all_spans))).drop(*cols)


def _verified(docs: DataFrame, rules=RULES) -> DataFrame:
    """``_s1_row``, the whole row, with ``_s1_text`` and ``_s1_spans``."""
    index, grams = build_index(docs, rules)
    found = candidates(index, grams, rules)
    keyed = docs.select(F.col("doc_id").cast("long").alias("_s1_id"), text_or_empty(docs).alias("_s1_text"),
                        F.struct("*").alias("_s1_row"))
    # A null doc_id is in no posting list: such rows are verified by every rule.
    mask = F.when(F.col("_s1_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("_s1_mask", F.lit(0)))
    return _with_spans(keyed.join(found, "_s1_id", "left").withColumn("_s1_mask", mask), rules)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans: an array of (start, kind, end), by start, then kind
    as listed in ``rules``."""
    name = F.array(*[F.lit(r.kind) for r in rules])
    slim = docs.select("doc_id", F.col("text").alias("text"))
    return _verified(slim, rules).select(
        F.col("_s1_row.doc_id").alias("doc_id"), F.transform("_s1_spans", lambda s: F.struct(
            s["start"], F.get(name, s["kind"]).alias("kind"), s["end"])).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mask: str = MASK) -> DataFrame:
    """All documents and columns; every stretch of a text that spans cover is
    replaced by ``mask``, and ``n_chars``, if there, follows."""
    df = _verified(docs, rules)
    text = F.col("_s1_text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        apart = F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"),
                        F.when((x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (F.size(s["out"]) == 0)), apart)
                        .otherwise(s["out"]).alias("out"))

    masked = F.aggregate("_s1_spans", start, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    found = F.size("_s1_spans") > 0
    new = {"text": F.when(found, masked).otherwise(F.col("_s1_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.char_length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("_s1_row.n_chars"))
    return df.select(*[new.get(c, F.col("_s1_row").getField(c)).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
