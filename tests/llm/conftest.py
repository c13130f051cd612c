import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """All documents of the smallest folder as (doc_id, text)."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Make a table of (doc_id, text) rows whose other columns have names that operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string")
        if extra:
            for c in brute.CLASHING.split(", "):
                name, kind = c.split(" ")
                df = df.selectExpr("*", f"cast('x' as {kind}) as `{name}`")
        return df

    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank and very long texts, ties, copies, near copies, chains, repeated stretches and repeated rows."""
    near = BASE.replace("tok30", "changed")
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, LONG), (8, LONG + " tail"), (9, BASE), (10, BASE), (11, near),
        (12, near.replace("tok10", "other")), (13, "lead " + " ".join(BASE.split()[:20]) + " trail"), (14, "a\nb\nc\nd"), (15, "x\na\nb\nc\ny"),
        (16, "a\nb\nc\na\nb\nc"), (17, " nbsp inside É é"), (18, "Under the MIT License. Under the MIT license; APACHE license, version 2.0"),
        (19, "mail a.b@c.example.org or 1.2.3.4 or 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 123-4567"), (20, "4111-1111-1111-1112 +12 x@y"),
        (21, "12345 !!! 67890"), (22, "cc by nc cc by nc 4.0"), (23, "one two"),
    ]
