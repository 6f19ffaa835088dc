"""Text functions that Spark has no built-in for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nfc(text: Column) -> Column:
    """Unicode normal form C, for comparison only. Neither Spark nor Arrow composes characters, so Python does."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return compose(text)


def with_nfc(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the composed form of a text column; only rows beyond ASCII, and nulls, go through Python."""
    plain = F.coalesce(F.col(column).rlike(r"^[\x00-\x7F]*$"), F.lit(False))
    return df.where(plain).withColumn(name, F.col(column)).unionByName(df.where(~plain).withColumn(name, nfc(F.col(column))))


def glob_to_regex(pattern: str) -> str:
    """An anchored Java regex for a shell pattern with *, ?, [seq] and [!seq]."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 if pattern[i : i + 1] not in ("!", "]") else i + 2)
            if end < 0:
                out.append("\\[")
                continue
            inner = pattern[i:end]
            i = end + 1
            negate, inner = inner.startswith("!"), inner.removeprefix("!")
            inner = "".join("\\" + x if x in "\\[]&^~" else x for x in inner)
            out.append(f"[{'^' if negate else ''}{inner}]")
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() and not c.isspace() and c != "_" else c)
    return "(?s)^" + "".join(out) + "$"
