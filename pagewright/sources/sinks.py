"""Where results go: Parquet for tables, one line of JSON for each response."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(results: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Results as Parquet, in folders by the values of ``by`` if given."""
    writer = results.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_responses(responses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line for each batch: its ``response``."""
    responses.select("response").write.mode(mode).text(path)
