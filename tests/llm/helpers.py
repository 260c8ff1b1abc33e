"""Brute-force versions and awkward rows that the operators' tests share."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
#: (doc_id, text): null, empty, blank, short, repeated, long, and copies with the same id.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, "A b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (7, "a B c d e f g h i j k l m n o p q r s t u v w x y z"), (8, LONG), (9, LONG + " tail"), (None, "no id at all here"), (10, "x " * 50), (11, "éà naïve \U0001f600 <|im_end|> % \\"),
]
#: Names that the operators use inside, as columns of the caller's.
EXTRA = ("block", "live_hashes", "live_doc_id", "_shard", "group", "path", "hash", "place", "next", "word")


def awkward(spark, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(c) for c in EXTRA})
    return df


def empty(spark):
    return awkward(spark).filter("false")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)
