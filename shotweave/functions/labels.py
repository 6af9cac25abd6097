"""Label values: text forms, negation, masks and comparison direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must equal the published data format.
MISSING = -100
YES, NO = "Yes", "No"
CODE_TEXT = {"N": NO, "Y": YES}
INT_KIND, FLOAT_KIND, TEXT_KIND = "int", "float", "str"


def two_decimals(value: Column) -> Column:
    """Number rounded half up to two places, written with at least one: ``1.5``, ``2.0``, ``0.13``.

    NULL where it is no finite number below 10^36. The decimal is read from the number's text, so it is rounded once.
    """
    return F.regexp_replace(value.cast("string").try_cast("decimal(38,2)").cast("string"), "0$", "")


def number_text(value: Column) -> Column:
    """A double written out without loss and without exponent: ``12345678.0``, ``0.0001``, ``-0.845``.

    Numbers that 38 digits cannot hold exactly keep the exponent form; NaN and the infinities keep their names.
    """
    short = value.cast("double").cast("string")
    wide = F.when(F.abs(value) < 1, short.try_cast("decimal(38,37)").cast("string")).otherwise(
        short.try_cast("decimal(38,8)").cast("string"))
    plain = F.regexp_replace(wide, r"(\.\d+?)0+$", "$1")
    exact = plain.try_cast("double") == value
    return F.when(short.contains("E") & F.coalesce(exact, F.lit(False)), plain).otherwise(short)


def plain_text(df: DataFrame, name: str) -> Column:
    """Text of a column; doubles through :func:`number_text`."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return number_text(F.col(name))
    return F.col(name).cast("string")


def label_text(value: Column, kind: Column) -> Column:
    """Text of a raw property value (given as a string) according to the kind of its column.

    An unknown kind gives NULL.
    """
    number = value.try_cast("double")
    coded = value
    for code, text in CODE_TEXT.items():
        coded = F.when(value == code, text).otherwise(coded)
    return (
        F.when(kind == INT_KIND, F.coalesce(value.try_cast("bigint"), number.try_cast("bigint")).cast("string"))
        .when(kind == FLOAT_KIND, two_decimals(number))
        .when(kind == TEXT_KIND, coded)
    )


def negate_text(label: Column) -> Column:
    """Negated label text; NULL where the label has no negation.

    Whole numbers lose their decimals: ``2.0`` becomes ``-2``. Numbers beyond 38 digits, NaN and infinities have none.
    """
    number = label.try_cast("double")
    return (
        F.when(number % 1 == 0, (-number.try_cast("decimal(38,0)")).cast("string"))
        .when(number.isNotNull(), two_decimals(-number))
        .when(label == YES, NO)
        .when(label == NO, YES)
    )


def label_code(label: Column) -> Column:
    """``N``/``Y`` to 0/1; numeric text to its number."""
    return F.when(label == "N", 0.0).when(label == "Y", 1.0).otherwise(label.try_cast("double"))


def sign_text(signed: Column) -> Column:
    """Yes for positive, No for negative, NULL for a missing (zero) cell."""
    return F.when(signed > 0, YES).when(signed < 0, NO)


def class_text(label: Column) -> Column:
    """Yes for 1, No for 0, NULL for anything else."""
    return F.when(label == 1.0, YES).when(label == 0.0, NO)


def output_text(label: Column, kind: Column) -> Column:
    """Published form of a test label: Yes/No for classification, the number as it is for regression."""
    return F.when(kind == "cla", class_text(label)).otherwise(number_text(label))


def better(result: Column, reference: Column, kind: Column) -> Column:
    """Whether ``result`` beats ``reference``: larger for ``cla``, smaller for ``reg``."""
    return F.when(kind == "cla", result > reference).when(kind == "reg", result < reference)
