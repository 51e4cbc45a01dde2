"""The edge of the application: request parameters, JSON, rounding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facets import normalise

#: Digits that results are shown with.
DIGITS = {"conf": 4, "lift": 2, "none_p": 3}


@dataclass(frozen=True)
class Parameter:
    """A parameter of a request. Kinds: number (within least and most), flag (1 or not), list (comma-separated; cut to the known
    values, if there are any), names (a list, normalised), json (a list of strings in JSON; null for anything else)."""

    name: str
    kind: str
    column: str
    default: float | None = None
    least: float | None = None
    most: float | None = None
    whole: bool = True
    known: Sequence[str] | None = None


PARAMETERS = (
    Parameter("exclude", "names", "excluded"),
    Parameter("people", "number", "people", 1, 1, 3),
    Parameter("on", "json", "switched_on"),
    Parameter("must", "flag", "must_all"),
    Parameter("req", "list", "must"),
    Parameter("cos", "list", "costumes", known=()),
    Parameter("design", "list", "design"),
    Parameter("charcap", "number", "entity_cap", 100, 0),
    Parameter("temp", "number", "temperature", 1, 0.1, whole=False),
)


def _value(query: Column, name: str) -> Column:
    """The first value of that name, decoded; null if there is none or it can't be decoded."""
    pairs = F.filter(F.split(query, "&"), lambda x: F.startswith(x, F.lit(f"{name}=")))
    return F.try_url_decode(F.substr(F.get(pairs, F.lit(0)), F.lit(len(name) + 2)))


def read(query: Column, p: Parameter) -> Column:
    """A parameter of a query string as its declaration says; what is absent or can't be read has the default, or is empty."""
    text = _value(query, p.name)
    if p.kind == "flag":
        return F.coalesce(text == "1", F.lit(False))
    if p.kind == "json":
        return F.from_json(text, "array<string>")
    if p.kind == "number":
        number = F.coalesce(F.btrim(text).try_cast("double"), F.lit(float(p.default)))
        number = F.when(F.isnan(number), float(p.default)).otherwise(number)
        number = F.greatest(number, F.lit(float(p.least))) if p.least is not None else number
        number = F.least(number, F.lit(float(p.most))) if p.most is not None else number
        return F.floor(number).cast("int") if p.whole else number
    one = normalise if p.kind == "names" else lambda x: F.btrim(x)
    values = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), one), lambda x: x != "")
    return F.filter(values, lambda x: x.isin(list(p.known))) if p.known is not None else values


def requests(df: DataFrame, column: str, parameters: Sequence[Parameter] = PARAMETERS) -> DataFrame:
    """df with a column for each parameter of its query strings. A null query has all defaults."""
    return df.select("*", *(read(F.coalesce(F.col(column), F.lit("")), p).alias(p.column) for p in parameters))


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text as columns; null where it can't be read."""
    return df.select(F.from_json(column, schema).alias("parsed")).select("parsed.*")


def shown(df: DataFrame) -> DataFrame:
    """Shares, lifts and chances rounded for display, counts whole."""
    out = df
    for name, digits in DIGITS.items():
        if name in df.columns:
            out = out.withColumn(name, F.round(name, digits))
    return out.withColumn("k", F.round("k").cast("int")) if "k" in df.columns else out


def as_json(rolled: DataFrame) -> DataFrame:
    """One row: a roll as a JSON list in facet order. A roll has a few dozen rows."""
    rows = F.array_sort(F.collect_list(F.struct(*rolled.columns)))
    return rolled.agg(F.to_json(rows).alias("roll"))
