"""Small tables with the awkward cases every operator must define a result for."""

import random

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

#: Extra columns whose names the operators use inside.
CLASH = ["_doc", "_id", "_t", "_fp", "_row", "keep_id", "group_size", "Mix_Key", "score", "size", "h", "grams"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward_rows(seed=3, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(5, 80)) for _ in range(n)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", None, None) for i in range(6)]                # exact copies
    rows += [(200 + i, base[i] + " zusatz", "de", "s0", 1) for i in range(6)]       # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n", "en", "s1", 3),
             (303, "ein", "de", "s2", 3), (None, base[7], "en", "s3", 1), (None, None, None, "s3", None),
             (7, base[7], "en", "s3", 1), (7, base[7], "en", "s3", 1),              # repeated rows
             (304, words(rng, 30_000), "en", "s2", 9),                              # a very long text
             (305, base[9][:70] + base[10][:90] + base[11], "en", "s1", 2)]
    return rows


def frame(spark, rows, clash=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def shuffled(df, parts=5):
    return df.repartition(parts, "text")
