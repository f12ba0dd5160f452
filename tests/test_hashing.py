import random

from pyspark.sql import functions as F

from tidewheel.functions import hashing


def _java(text: str) -> int:
    h = 0
    raw = text.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h * 31 + (raw[k] << 8 | raw[k + 1])) & 0xFFFFFFFF
    return h


def test_string_hash_counts_utf16_units(spark):
    texts = ["", "a", "member-alpha", "é中", "😀x", "x" * 200]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select("s", hashing.string_hash(F.col("s")).alias("h")).collect()
    assert {r.s: r.h for r in found} == {t: _java(t) for t in texts}
    assert spark.sql("select cast(null as string) s").select(hashing.string_hash(F.col("s"))).first()[0] == 0


def test_groups_and_subtasks_of_known_members(spark):
    want = {"m-1001": (8, 0), "m-1002": (83, 2), "m-1003": (60, 1), "m-1004": (96, 3), "m-1005": (12, 0), "member-alpha": (37, 1), "member-beta": (110, 3)}
    group = hashing.key_group(hashing.string_hash(F.col("m")))
    found = spark.createDataFrame([(m,) for m in want], "m string").select("m", group.alias("g"), hashing.subtask(group, 4).alias("s"))
    assert {r.m: (r.g, r.s) for r in found.collect()} == want


def test_hot_key_counts_by_subtask(spark):
    clicks = spark.range(16000).select(
        F.lit("member-hot").alias("m"),
        F.concat(F.lit("catalog-"), (F.col("id") % 37).cast("string")).alias("i"),
        F.concat(F.lit("query-"), (F.col("id") % 23).cast("string")).alias("q"),
        F.lit("RESULT_CLICK").alias("e"),
        (F.col("id") + 1000).alias("t"),
    )
    plain = clicks.groupBy(hashing.subtask(hashing.key_group(hashing.string_hash(F.col("m"))), 4).alias("s")).count().collect()
    assert {r.s: r["count"] for r in plain} == {3: 16000}
    salted = clicks.withColumn("salt", hashing.payload_salt(*(F.col(c) for c in "miqet")))
    # the hash of a key of two fields: 31 times the first's, and the second
    key = (hashing.string_hash(F.col("m")) * 31 + F.col("salt")).bitwiseAND(F.lit(0xFFFFFFFF))
    spread = salted.groupBy(hashing.subtask(hashing.key_group(key), 4).alias("s")).count().collect()
    assert {r.s: r["count"] for r in spread} == {0: 4924, 1: 3024, 2: 4123, 3: 3929}
    by_salt = [r["count"] for r in salted.groupBy("salt").count().collect()]
    assert len(by_salt) == 16 and all(16000 / 20 <= n <= 16000 / 12 for n in by_salt)


def test_groups_are_in_range_and_contiguous(spark):
    random.seed(1)
    keys = [(random.randint(-(2**63), 2**63 - 1),) for _ in range(2000)]
    group = hashing.key_group(hashing.long_hash(F.col("k")))
    found = spark.createDataFrame(keys, "k long").select(group.alias("g"), hashing.subtask(group, 5).alias("s")).collect()
    assert all(0 <= r.g < 128 and r.s == r.g * 5 // 128 for r in found)
    assert len({r.g for r in found}) == 128


def test_salt_is_a_function_of_the_payload(spark):
    df = spark.range(500).select(hashing.salt(F.col("id")).alias("a"), hashing.salt(F.col("id")).alias("b"))
    assert df.where("a <> b or a not between 0 and 15").isEmpty()
