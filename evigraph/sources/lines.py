"""Line formats: tab-separated nodes, adapter records with hexadecimal text, and checksummed log frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.scalar import fnv1a

BOM = "\ufeff"


def rows(spark: SparkSession, path: str, fields: int) -> tuple[DataFrame, DataFrame]:
    """(p, an array of fields) of lines that are neither empty nor comments, and those with another number of fields."""
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value")).filter("value <> '' AND value NOT LIKE '#%'")
    split = lines.select("value", F.split("value", "\t").alias("p"))
    return split.filter(F.size("p") == fields).select("p"), split.filter(F.size("p") != fields).select("value")


def vector(text):
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(content, vec, signature, incident, root, symptom, impact) of five-column lines, and lines that don't parse."""
    good, bad = rows(spark, path, 5)
    p = lambda k: F.get("p", F.lit(k))
    out = good.select(p(0).alias("content"), vector(p(1)).alias("vec"), p(2).try_cast("bigint").alias("signature"), p(3).try_cast("bigint").alias("incident"), *[(p(4) == k).alias(k) for k in ("root", "symptom", "impact")], F.array_join("p", "\t").alias("value"))
    sound = F.col("signature").isNotNull() & F.col("incident").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    return out.filter(sound).drop("value"), bad.unionByName(out.filter(~sound).select("value"))


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nine-column records: content and metadata (k=v;k=v) come as hexadecimal digits."""
    good, bad = rows(spark, path, 9)
    p = lambda k: F.get("p", F.lit(k))
    text = lambda c: F.try_to_binary(c, F.lit("hex")).cast("string")
    out = good.select(
        p(0).alias("external_id"), p(1).alias("type"), p(2).try_cast("bigint").alias("signature"), p(3).try_cast("bigint").alias("incident"), (p(4) == "1").alias("root"), (p(5) == "1").alias("symptom"),
        vector(p(6)).alias("vec"), text(p(7)).alias("content"), F.str_to_map(text(p(8)), F.lit(";"), F.lit("=")).alias("metadata"), F.array_join("p", "\t").alias("value"),
    )
    sound = F.col("signature").isNotNull() & F.col("incident").isNotNull() & F.col("content").isNotNull()
    return out.filter(sound).drop("value"), bad.unionByName(out.filter(~sound).select("value"))


def frame(payload):
    """length|checksum|payload, the checksum as an unsigned number."""
    return F.concat_ws("|", F.octet_length(payload).cast("string"), F.conv(F.hex(fnv1a(payload)), 16, 10), payload)


def replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(txid, op, rest) of committed records, and the corrupt lines.

    A record counts if its transaction has a BEGIN and a COMMIT. Any line whose length or checksum is off is corrupt; a
    caller takes the last line of a log for a torn tail and any other for damage.
    """
    raw = spark.read.text(path).filter("value <> ''").select("value", F.split("value", r"\|", 3).alias("p"))
    payload = F.get("p", F.lit(2))
    sound = F.coalesce((F.octet_length(payload).cast("string") == F.get("p", F.lit(0))) & (F.conv(F.hex(fnv1a(payload)), 16, 10) == F.get("p", F.lit(1))), F.lit(False))
    checked = raw.select("value", payload.alias("payload"), sound.alias("sound"))
    part = F.split("payload", "\t", 3)
    good = checked.filter("sound").select(F.get(part, F.lit(1)).try_cast("bigint").alias("txid"), F.get(part, F.lit(0)).alias("op"), F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("rest"))
    whole = good.filter("op IN ('BEGIN', 'COMMIT')").groupBy("txid").agg(F.count_distinct("op").alias("k")).filter("k = 2")
    return good.filter("op NOT IN ('BEGIN', 'COMMIT')").join(whole.select("txid"), "txid", "left_semi"), checked.filter("NOT sound").select("value")
