"""The registered queries and the equivalent SQL of each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.plans.inputs import Inputs
from touchline.sources.bridge import BRIDGE_SQL

DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_texts: dict[str, tuple[str, bool, bool]] = {}
# Shared parts of the comparison SQL: name -> (text after ``name as``, names it uses).
PARTS: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: decimals and doubles as doubles with six places."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0:
            out.append(c.cast("bigint").alias(field.name))
        elif isinstance(field.dataType, T.DecimalType | T.DoubleType | T.FloatType):
            # Adding zero turns a rounded -0.0 into 0.0.
            out.append((F.round(c.cast("double"), DIGITS) + F.lit(0.0)).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def num(expression: str, name: str) -> str:
    """The same rounding on the SQL side."""
    return f"round(cast({expression} as double), {DIGITS}) + 0.0e0 as {name}"


def nums(*names: str) -> str:
    return ", ".join(num(n, n) for n in names)


def part(name: str, text: str) -> None:
    PARTS[name] = text


def with_parts(select: str, recursive: bool = False) -> str:
    """Prefix the shared parts that ``select`` uses, in the order they were declared."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[A-Za-z_]\w*", text)):
            if word in PARTS and word not in needed:
                needed.add(word)
                visit(PARTS[word])

    visit(select)
    chosen = [f"{n} as ({PARTS[n]})" for n in PARTS if n in needed]
    lead = "with recursive " if recursive else "with "
    body = select.strip()
    if body.lower().startswith("with "):
        body = body[5:]
        return f"{lead}{BRIDGE_SQL},\n" + ",\n".join([*chosen, body])
    return f"{lead}{BRIDGE_SQL}" + "".join(",\n" + c for c in chosen) + "\n" + body


def query(name: str, sql: str | None = None, bridge: bool = True, recursive: bool = False):
    """Register ``build(inputs) -> DataFrame`` under ``name``."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Inputs(spark, folder)))
        if sql is not None:
            _texts[name] = (sql, recursive, bridge)
        return build

    return add


def compose() -> None:
    """Fill ``SQL`` once all parts are declared, whichever module declares them."""
    SQL.update({name: with_parts(sql, recursive) if bridge else sql for name, (sql, recursive, bridge) in _texts.items()})
