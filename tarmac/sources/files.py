"""File sources and sinks: S1 CSV scan, S2 cleaned-table sink, S3 stage hand-over, S6 preview.

CSV is read with a declared schema (no inference pass over the data): every column is
read as text, the missing-value markers a pandas reader treats as NaN become NULL, and
only then are columns cast to their declared types - so a marker such as 'NA' in a
numeric column is a NULL, not a parse error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BOOKING_SCHEMA

# FIXED VALUES: the default missing-value markers of a pandas CSV reader.
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                   "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                   "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType = BOOKING_SCHEMA,
             lenient_dates: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header row -> typed DataFrame; markers -> NULL; dates parsed.

    Columns are taken by their header name, in any order; one that the file lacks is an
    error, further ones are ignored.  Quotes inside a quoted field are doubled, and a
    quoted field may hold line breaks; a file is then read by one task.  With ``multi_line``
    False, for files without such breaks, a large file is split among many tasks.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST")
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("nullValue", None).option("emptyValue", "").csv(path))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"the CSV header lacks {', '.join(missing)}")
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.when(c.isNull() | c.isin(*MISSING_MARKERS), F.lit(None)).otherwise(c)
        if isinstance(f.dataType, T.DateType):
            c = (F.try_to_date(c) if lenient_dates else F.to_date(c))
        elif not isinstance(f.dataType, T.StringType):
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


#: Rows of a written CSV file: a file whose quoted fields may hold line breaks is read by one task.
CSV_FILE_ROWS = 100_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write without a row index (parquet keeps types; CSV optional with a header, in
    files of ``CSV_FILE_ROWS`` rows at most)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path)
    else:
        w.parquet(path)


def hand_over(df: DataFrame, path: str) -> DataFrame:
    """S3: stage boundary through a file - write, then continue from the written table."""
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows (scan stops early)."""
    return df.limit(n)


def tail(df: DataFrame, n: int = 3, key: str = "booking_id") -> DataFrame:
    """Last n rows by a key - a top-n on the reversed key, never a full sort collect."""
    return df.orderBy(F.col(key).desc()).limit(n).orderBy(key)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)
