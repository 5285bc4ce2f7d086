"""Awkward small inputs that every operator must survive, and plain versions to compare with."""

import itertools
import re

from pyspark.sql import functions as F

LONG = " ".join(f"wort{i % 977}" for i in range(60_000))
ROWS = [
    (0, "the quick brown fox jumps over the lazy dog. It was a fine day."),
    (1, "the quick  brown fox jumps\nover the lazy dog.\tIt was a fine day."),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "one"),
    (5, "one"),
    (6, "Licensed under the MIT License. ### <|endoftext|> don't  stop 123 ünïcödé 漢字テスト 🙂🙂"),
    (None, "a row without an id"),
    (None, None),
    (7, LONG),
    (8, LONG + " end"),
    (9, "one two three four five six"),
    (10, "ONE two three four five six"),
]
#: Columns whose names clash with names that the operators use themselves.
EXTRA = ("id", "uid", "key", "fp", "sk", "bucket", "share", "block", "score", "row_key", "log_weight", "next", "n", "recipe", "bin")


def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for i, c in enumerate(EXTRA):
        df = df.withColumn(c, F.when(F.col("doc_id") % 2 == 0, F.lit(str(i))))
    return df


def labels(spark, rows=((0, 1, 0), (1, 0, 1), (5, 1, None), (None, 1, 1), (9, None, 0), (9, 1, 1), (12, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def empty(spark):
    return awkward(spark).limit(0)


def classes(n, linked):
    """Component (smallest member) of 0..n-1 by the pair predicate, all pairs tried."""
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [find(i) for i in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df, *cols):
    """Rows as sorted tuples, nulls and all."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
