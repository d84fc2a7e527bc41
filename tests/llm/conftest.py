import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"w{i % 977} x{i}." for i in range(30_000))
PROSE = "It was a day like any other in the small town, and nobody had seen the visitor come, with his hat and his dog."


@pytest.fixture(scope="session")
def rows(small):
    """All (doc_id, text) rows of the smallest documents table."""
    t = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, " \n\t\n"), (4, PROSE), (4, PROSE), (5, PROSE), (6, PROSE + " The end."), (7, LONG),
        (8, LONG + " more"), (9, "one"), (10, "ONE"), (11, "one two three"), (12, "\n\n" + PROSE + "\r\n" + PROSE),
        (13, "x" * 70_000), (14, "7" * 50_000 + "@"), (None, PROSE), (None, None),
        (15, "mail a.b@c-d.org, ip 10.0.0.256 1.2.3.4, +1 (555) 010-0199, card 4111 1111 1111 1111 é😀 x@y.z"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows with columns whose names the operators use inside."""
    extra = ["node", "bucket", "id", "words", "length", "_text", "kept", "row", "piece", "group", "first", "_id"]
    return spark.createDataFrame(
        [(*r, *[None if i % 2 else "x"] * len(extra)) for i, r in enumerate(odd_rows)],
        "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def collected(table):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in table.collect()), key=key)
