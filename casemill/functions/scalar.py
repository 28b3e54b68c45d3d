"""Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def age_in_months(value: Column, unit: Column) -> Column:
    """Years become ``12 * years + 6``; any other unit, or none, is taken as months."""
    return F.when(unit == "year", value * 12 + 6).otherwise(value)


def ids_of(items: Column) -> Column:
    """The ``id`` field of every struct in an array; a missing array counts as empty."""
    return F.coalesce(items.getField("id"), F.array().cast("array<string>"))


def list_length(items: Column) -> Column:
    """Length of a list; a null list has length 0 (``size`` alone gives -1 or null)."""
    return F.when(items.isNull(), F.lit(0)).otherwise(F.size(items))


def list_label(items: Column) -> Column:
    """Render a list of strings as one label, for example ``['A00-B99', 'N00-N99']``.

    Strings are quoted as Python does: in double quotes if they hold single ones only, with
    backslashes, tabs and line ends escaped. A null is ``None``.
    """

    def rendered(item: Column) -> Column:
        text = item
        for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\x00")):
            text = F.replace(text, F.lit(plain), F.lit(code))
        single, double = item.contains("'"), item.contains('"')
        return (
            F.when(item.isNull(), F.lit("None"))
            .when(single & ~double, F.concat(F.lit('"'), text, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, rendered), ", "), F.lit("]"))


def block_start(block: Column) -> Column:
    return F.split(block, "-").getItem(0)


def block_end(block: Column) -> Column:
    return F.split(block, "-").getItem(1)


def in_closed_range(key: Column, low: Column, high: Column) -> Column:
    """Lexicographic test; Spark's binary string order is code-point order."""
    return (key >= low) & (key <= high)


def category_of(code: Column) -> Column:
    """The three-character category of an ICD-10 code."""
    return F.substring(code, 1, 3)


def to_number(text: Column) -> Column:
    """Numeric value of a text, null where it is not a number."""
    return text.try_cast("double")


def null_if_nan(score: Column) -> Column:
    """Spark orders NaN above every number, so a failed score must be null before ranking."""
    return F.when(~F.isnan(score), score)
