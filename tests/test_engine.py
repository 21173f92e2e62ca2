"""The evidence engine against DuckDB on the smallest tables, and scans of small texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner import cases, registry  # noqa: F401
from gleaner.operators import blocks, scan

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(map(str, r)) for r in got.select(cols).collect()) == sorted(tuple(map(str, r)) for r in want)


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "card": "Card number 4111 1111 1111 1111",
        "bare": "4111111111111112 is no card",
        "sample": "sample card 4111111111111111",
        "dob": "Birth date: 03/04/1985\nAdoption date: 05/06/2001",
        "deadline": "The filing deadline is 04/15/2024.",
        "phone": "Phone: 1-212-555-1212",
        "service": "Questions? Contact support@acme.com",
        "iban": "IBAN: GB82 WEST 1234 5698 7654 32",
        "seats": "License (50 seats) costs 100",
        "name": "Full Name: Ana Maria River",
        "empty": "",
        "null": None,
    }
    df = spark.createDataFrame(list(texts.items()), "source_ref string, text string")
    return sorted((r["source_ref"], r["pii_type"], r["normalized_value"]) for r in scan.scan(df).collect())


def test_scan_of_small_texts(found):
    assert found == [("card", "CREDIT_CARD", "4111111111111111"), ("dob", "DOB", "1985-03-04"), ("iban", "IBAN", "GB82WEST12345698765432"), ("name", "FULL_NAME", "ANA MARIA RIVER"), ("phone", "PHONE", "2125551212")]


def test_blocks(spark):
    text = "a\nb\n\nName\tMail\nc\n[Sheet: x]\n\n\nd"
    df = spark.createDataFrame([("s", text)], "source_ref string, text string")
    got = blocks.segment(df).orderBy("block_ix").collect()
    assert [(r["block_ix"], r["start"], r["end"], r["text"]) for r in got] == [(0, 0, 4, "a\nb"), (1, 5, 15, "Name\tMail"), (2, 15, 17, "c"), (3, 17, 28, "[Sheet: x]"), (4, 30, 31, "d")]
    near = blocks.neighbours(blocks.segment(df), 1).filter(F.col("block_ix") == 0).collect()
    assert [(r["other_ix"], r["distance"]) for r in near] == [(1, 1)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
