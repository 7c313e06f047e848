"""CSV export of the comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions.scalars import spreadsheet_safe

# Exported columns and their titles.
COMPARISON_TITLES = {
    "label": "Dimension",
    "current": "Cost",
    "previous": "Previous Cost",
    "absolute_change": "Difference",
    "percentage_change": "Difference %",
    "percentage_total": "% Total",
}


def exportable(table: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """Titled columns; text that a spreadsheet would run as a formula is neutralised."""
    titles = titles or COMPARISON_TITLES
    kinds = dict(table.dtypes)
    return table.select(
        *[
            (spreadsheet_safe(F.col(name)) if kinds[name] == "string" else F.col(name)).alias(title)
            for name, title in titles.items()
        ]
    )


def write_csv(table: DataFrame, path: str, titles: dict[str, str] | None = None) -> None:
    """Header line, quotes doubled, a field quoted when it needs to be; blanks at the ends of a text are
    kept. Rows keep their order."""
    writer = exportable(table, titles).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
