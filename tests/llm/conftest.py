from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASH = "kind string, row long, _row long, token string, key long, n int, bucket int, label long, node long, spans string, h long, c long, _first string, s1 long, _doc long, line string, _key string, _kept string, _spans string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, clashing columns."""
    long = "word " * 30_000
    texts = [
        (1, "The quick brown fox jumps over the lazy dog today", "en"), (1, "The quick brown fox jumps over the lazy dog today", "en"), (2, "The  quick brown fox\tjumps over the lazy dog today", None),
        (3, None, "en"), (4, "", "de"), (None, "kein Name hier, nur ein Satz", "de"), (None, None, None), (5, long, "en"), (6, "a" * 60_000, None), (7, "1" * 50_000, "fr"), (8, " \t\n ", "fr"),
        (9, "mail bob@example.com or +1 (555) 123-4567, 10.0.0.1, 4539 1488 0343 6467", "en"), (10, " ▁ \U0001f600 é", "es"), (11, "x", "es"), (12, "@" * 20_000, None), (13, "a.b-" * 15_000, None),
    ]
    extra = (None,) * len(CLASH.split(", "))
    return spark.createDataFrame([(i, t, lang, None, None, *extra) for i, t, lang in texts], f"{SCHEMA}, {CLASH}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
