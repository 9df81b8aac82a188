"""Small tables with the awkward cases, and readers of the driver's tables."""

import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null ids, texts, labels; empty, white, repeated and long rows; ties.
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "s", 7),
    (4, "the cat sat on the mat and then it ran away from the big dog", "en", "s", None),
    (4, "the cat sat on the mat and then it ran away from the big dog", "en", "s", None),
    (5, "the cat  sat on the mat and then it ran away from the big dog", "en", None, None),
    (None, "the cat sat on the mat and then it ran away from the big dog", "en", "t", None),
    (6, "word", "en", "t", 4),
    (7, "12345 !!! 678", None, "t", 1),
    (8, "lorem ipsum " * 40_000, "fr", "u", 480_000),
    (9, "x" * 200_000, "fr", "u", 200_000),
    (10, "héllo wörld ñandú 日本語 🤦🏼‍♂️   done", "es", "u", 20),
]


def awkward(spark, extra=True):
    df = spark.createDataFrame(AWKWARD, DOCS)
    if extra:  # columns whose names the operators use inside
        for c in ("digest", "n", "h", "size", "token", "id", "rep", "score", "__id", "keep_id", "start", "shard"):
            df = df.selectExpr("*", f"'{c}' AS `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(name, sf_dir=DATA):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()
