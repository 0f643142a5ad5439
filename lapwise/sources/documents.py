"""JSON sinks: one document per line, written in parallel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(documents: DataFrame, column: str = "document") -> DataFrame:
    """The other columns, and the document as JSON text."""
    others = [c for c in documents.columns if c != column]
    return documents.select(*others, F.to_json(column, {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
