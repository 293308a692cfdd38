import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

#: Names that the operators use inside, with other meanings.
CLASHES = ["id", "key", "row", "fp", "sha", "score", "kept", "rejected", "bucket", "slot", "_id", "_text", "h", "gone"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *(T.StructField(c, T.StringType()) for c in CLASHES)])


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, with clashing extra columns."""
    def make(pairs, parts=3, lang=None):
        rows = [Row(*([i, t, (lang or {}).get(i), None, None if t is None else len(t)] + ["x"] * len(CLASHES)))
                for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return make


WORDS = "the stone river under wide morning carries small boats toward harbour lights and quiet people wait".split()


def prose(n, seed=0):
    return " ".join(WORDS[(k * k * 7 + seed * 13 + k) % len(WORDS)] + ("x" * (k * seed % 5)) for k in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, a very long text.
EDGE = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "ab"), (5, "ab"), (6, "A\x0bB"),
        (7, prose(60_000, 3)), (8, "naïve café №5 — 漢字 😀 İstanbul ſ"), (9, "password: hunter22 'token=abc'"),
        (10, prose(50, 1)), (11, prose(50, 1)), (-4, "\n\n"), (1 << 62, "<|endoftext|> it's 'll  x<|startoftext|>")]
