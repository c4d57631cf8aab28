"""Corpus -> paragraphs -> normalised text.

All steps are narrow: a document row is split where it lies, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.functions.text import normalize, quote_regex


def split_paragraphs(docs: DataFrame, sep: str = "\n\n", text_col: str = "text",
                     carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per paragraph: ``carry..., para_idx INT, text``.

    Literal, left-to-right split that keeps empty pieces (``str.split(sep)``);
    ``\\n\\n\\n`` leaves a leading newline on the next piece.
    """
    parts = F.split(F.col(text_col), quote_regex(sep), -1)
    return docs.select(*carry, F.posexplode(parts).alias("para_idx", "text"))


def normalize_paragraphs(paras: DataFrame, text_col: str = "text") -> DataFrame:
    """Collapse whitespace runs to one space and lower-case (no trim)."""
    return paras.withColumn(text_col, normalize(text_col))
