"""Documents with every awkward row, and columns whose names the operators use themselves."""

from pyspark.sql import types as T

CLASHES = ["size", "rank", "code", "label", "kept", "votes", "word", "n", "a", "b", "p", "hit", "row", "id"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)
PROSE = "The quick brown fox jumps over the lazy dog while seven other animals look on. They had seen it all before, and none of them was much impressed by it."
LICENSED = PROSE + "\nLicensed under the Apache License, Version 2.0."


def texts():
    long_ = " ".join(f"word{k % 997} and{k % 31}." for k in range(30_000))
    return [
        (1, PROSE), (1, PROSE), (2, PROSE), (3, PROSE + " Indeed."), (None, "a text without a key " * 3), (None, None), (4, None), (5, ""), (6, " \n\t \r\n"), (7, "one"), (8, "Two words"),
        (9, long_), (10, "\x00\x01 odd \u2028 中文 🙂 é İ"), (11, "same same same same same same same same same same same same"), (12, LICENSED), (13, "l1\nl1\nl1\n" + PROSE), (2**62, PROSE.upper()),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(k, t, "en", [None, "", "x", "y"][i % 4], len(t) if t is not None else None, *["v"] * len(CLASHES)) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def key(value):
    return (value is None, value if value is not None else 0)
