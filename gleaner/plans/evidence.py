"""Synthetic evidence made of the star schema's keys, whose findings are known by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import spread

#: Expressions that Spark SQL and DuckDB read alike; k is c_custkey.
FIELDS = {
    "ssn": "lpad(cast(100 + k % 500 as string), 3, '0') || '-' || lpad(cast(10 + k % 89 as string), 2, '0') || '-' || lpad(cast(1000 + k * 7 % 8999 as string), 4, '0')",
    "mrn": "'A' || lpad(cast(10000 + k * 31 % 89999 as string), 5, '0')",
    "phone": "'(' || cast(212 + k % 700 as string) || ') ' || cast(234 + k * 3 % 700 as string) || '-' || lpad(cast(k * 11 % 10000 as string), 4, '0')",
    "dob": "cast(1940 + k % 60 as string) || '-' || lpad(cast(1 + k % 12 as string), 2, '0') || '-' || lpad(cast(1 + k % 28 as string), 2, '0')",
    "mail": "'ana.river' || cast(k as string) || '@gmail.com'",
    "passport": "'X' || lpad(cast(1000000 + k * 13 % 8999999 as string), 7, '0')",
    "ip": "'10.' || cast(k % 250 as string) || '.' || cast(k * 3 % 250 as string) || '.' || cast(k * 7 % 250 as string)",
    "ndc": "lpad(cast(10000 + k * 17 % 89999 as string), 5, '0') || '-' || lpad(cast(1000 + k * 3 % 8999 as string), 4, '0') || '-' || lpad(cast(10 + k % 89 as string), 2, '0')",
}
LINES = {"ssn": "SSN: ", "mrn": "MRN: ", "phone": "Mobile Phone: ", "dob": "Date of Birth: ", "mail": "Personal Email: ", "passport": "Passport Number: ", "ip": "Portal login device IP address: ", "ndc": "Prescription NDC: "}
#: Long enough that no rule's window reaches from one line to the next.
FILLER = "The quarterly gardening bulletin describes how tulips and oaks fare in sandy ground, which trees bear the wind, and why the meadow by the river stays green until late in the autumn of a dry year. " * 2


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_ref, text: a message a customer, one labelled value a line, filler between the lines."""
    base = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS k"))
    values = base.select("k", *[F.expr(v).alias(c) for c, v in FIELDS.items()])
    lines = [F.concat(F.lit(LINES[c]), F.col(c)) for c in FIELDS]
    body = []
    for x in lines:
        body += [x, F.lit(FILLER)]
    return values.select(F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".eml (email body)")).alias("source_ref"), F.concat_ws("\n", *body).alias("text"))
