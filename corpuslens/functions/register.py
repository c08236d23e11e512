"""The functions that SQL texts may call by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import german


def register(spark: SparkSession) -> None:
    """stem_de, cologne_code as Arrow functions, and the table function split_quotes(text) with (pos, quote)."""
    spark.udf.register("stem_de", german._udf(german.stem, "string"))
    spark.udf.register("cologne_code", german._udf(german.cologne, "string"))

    @F.udtf(returnType="pos int, quote string")
    class SplitQuotes:
        def eval(self, text: str):
            import re

            for i, m in enumerate(re.finditer(r"[„“«\"]([^„“”«»\"\n]{8,400})[“”»\"]", text or "")):
                yield i, m[1].strip()

    spark.udtf.register("split_quotes", SplitQuotes)
