"""Small fixtures that hold every odd case at once."""

from pyspark.sql import types as T

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near quiet rivers under pale moons".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str(x % 97) * (x % 5 == 0))
    return " ".join(out)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def odd_rows() -> list[tuple]:
    rows = [(i, sentence(i, 40 + i), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, None, "en", "s0", 0), (21, "", None, "s1", 0), (22, " \n\t ", "de", None, 3), (None, sentence(99, 50), "en", None, 1), (None, None, None, None, None)]
    rows += [(30, sentence(3, 43), "en", "s0", 1), (31, sentence(3, 43) + " tail", "en", "s0", 1), (32, sentence(5, 30_000), "en", "s1", 1)]
    rows += [(33, "one", "en", "s2", 1), (34, "One", "en", "s2", 1), (35, "12 34 !?", "en", "s2", 1), (7, sentence(7, 47), "en", "s1", 1)]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def crowded(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("score", "row", "key", "n", "h", "label", "src", "sid", "cid", "size", "held_out", "is_p", "token", "piece", "pos")
    return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})
