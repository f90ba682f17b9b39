"""Values to types, with the errors that a manifest wants: a value that does not fit fails the query and names its field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean true, whatever their case; every other text is false. Fixed values.
TRUE_TEXTS = ["true", "1", "t", "yes", "y"]


def _required(value: Column, kind: str, field: str, said: str) -> Column:
    return F.coalesce(value.try_cast(kind), F.raise_error(F.lit(f"{field} is not {said}")).cast(kind))


def as_int(value: Column, field: str) -> Column:
    """A whole number; NULL and what is none fail."""
    return _required(value, "long", field, "an integer")


def as_float(value: Column, field: str) -> Column:
    """A number; NULL and what is none fail."""
    return _required(value, "double", field, "a number")


def as_float_or_null(value: Column, field: str) -> Column:
    """A number or NULL; what is neither fails."""
    return F.when(value.isNotNull(), as_float(value, field))


def as_bool(value: Column, default: bool = False) -> Column:
    """Whether a text means true; the default for NULL."""
    return F.coalesce(F.lower(F.trim(value)).isin(TRUE_TEXTS), F.lit(default))
