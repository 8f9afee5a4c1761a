"""Whole documents for checks and fingerprints, and their text from other formats."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_of(name: str, data: bytes) -> str | None:
    """Text of md, txt, html or docx; null for a docx that can't be read."""
    if name.lower().endswith(".docx"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    text = data.decode("utf-8", "replace")
    if name.lower().endswith((".html", ".htm")):
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", text)
        text = re.sub(r"<[^>]*>", " ", text)
    return text


@F.pandas_udf(StringType())
def _text(path: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([text_of(p, bytes(c)) for p, c in zip(path, content)])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row for each file."""
    return spark.read.format("binaryFile").load(path).select("path", _text("path", "content").alias("text"))
