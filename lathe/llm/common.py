"""Helpers shared by the training-data operators.

Words come in two kinds, and both can be found on UTF-8 bytes because every
delimiter is ASCII and every non-ASCII character belongs to a word:

* *blank-split words* ``[^\\x20\\x09-\\x0D]+`` are ``bytes.split()``;
* *plain words* ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z
  are ``text.translate(PLAIN).split()``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.sources.tables import checkpoint, new_folder, spread  # noqa: F401

#: Larger than any real id: rows without a doc_id sort after all others.
NO_ID = 2**63 - 1

#: Maps A-Z to a-z, keeps 0-9, a-z and bytes of non-ASCII characters, blanks the rest.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; documents and pages of few files are spread over the cores, as they are worked on row by row."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table in ("documents", "pages") else rows


def as_bytes(array: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string array."""
    return array.cast(pa.large_binary()).to_pylist()


def plain(text: bytes | None) -> bytes:
    """The plain words of a text, each between single blanks: `` w1 w2 … wn ``."""
    words = (text or b"").translate(PLAIN).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key: ``_lathe_id``, the doc_id (null last), and ``_lathe_h``, a hash of the text."""
    text = F.col("text").cast("string")
    return docs.withColumn("_lathe_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("_lathe_h", F.xxhash64(text))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salt: Column, n: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join whose ``right`` has one row per key and whose ``left`` may be skewed.

    Each right row is repeated ``n`` times, so a hot key's left rows go to ``n`` tasks;
    both sides get an exchange of their own, so adaptive execution can split further.
    """
    left = left.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for rows that hold texts or are read in parts."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
