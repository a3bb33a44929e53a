"""XML with one root, read by many tasks.

The text is cut at the closing tag of the record, which is Spark's line separator
here, so a file is split like any other text however many records its root holds.
Each piece is one record with whatever stood before it; what precedes the opening tag
is dropped and the record is parsed by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of the XML records ``tag`` under any root, in files or a folder.

    A record may not hold a record of the same name, nor its closing tag in a
    comment. Text after the last record is no record. A record that cannot be parsed
    has null fields.
    """
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path)
    begin = F.regexp_extract("value", rf"(?s)<{re.escape(tag)}(?:\s[^>]*)?>.*", 0)
    whole = pieces.select(begin.alias("record")).where("record <> ''").select(F.concat("record", F.lit(f"</{tag}>")).alias("record"))
    parsed = whole.select(F.from_xml("record", StructType.fromDDL(schema).simpleString(), {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*")
