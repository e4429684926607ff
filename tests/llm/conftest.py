import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators might use themselves.
NAMES = (
    "id", "key", "h", "pos", "sh", "node", "score", "row", "chunk", "len", "rank", "start", "item", "item_id", "w", "s", "t", "bin", "span", "spans", "size", "place", "part", "late",
    "of_id", "of_key", "pair", "n", "x", "level", "doc", "a", "b", "tier", "window", "offset", "start_byte", "end_byte", "prefix", "shared", "y", "bytes",
)
EXTRA = T.StructType([*DOCS, *(T.StructField(n, T.LongType()) for n in NAMES)])


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)]


def prose(rng: random.Random, sentences: int = 8) -> str:
    return "\n".join(" ".join(words(rng, rng.randint(6, 12))).capitalize() + "." for _ in range(sentences))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) rows, with extra columns of clashing names on request."""

    def build(rows, extra=False):
        data = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        if extra:
            return spark.createDataFrame([(*r, *range(100, 100 + len(NAMES))) for r in data], EXTRA)
        return spark.createDataFrame(data, DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, repeats, a very long text and one of a single word."""
    rng = random.Random(5)
    same = prose(rng)
    long = " ".join(words(rng, 60_000))
    return [(1, None), (None, prose(rng)), (None, None), (2, ""), (3, "  \n\n "), (4, same), (4, same), (5, same), (6, long), (7, "word"), (8, prose(rng)), (-9, prose(rng)), (9, "é ü — 漢字\u0001\x00 end")]
