"""Numbers as people write them, parsed without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One written number: digits with points or commas between them.
WRITTEN = r"\d+(?:[.,]\d+)*"
NUMBER = "decimal(24,6)"


def written_number(text: Column) -> Column:
    """A written number as decimal(24,6); null if it is none.

    Groups of three digits after one kind of separator are thousands ('2.350', '6,820,000'), unless the
    first group is 0; of two kinds the last one is the decimal sign; else a separator is a decimal sign."""
    grouped = text.rlike(r"^[1-9]\d{0,2}(\.\d{3})+$") | text.rlike(r"^[1-9]\d{0,2}(,\d{3})+$")
    plain = F.regexp_replace(text, "[.,]", "")
    comma_last = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    point_last = F.regexp_replace(text, ",", "")
    both = text.contains(".") & text.contains(",")
    clean = (
        F.when(grouped, plain)
        .when(both & (F.locate(",", F.reverse(text)) < F.locate(".", F.reverse(text))), comma_last)
        .when(both, point_last)
        .otherwise(F.regexp_replace(text, ",", "."))
    )
    return clean.try_cast(NUMBER)
