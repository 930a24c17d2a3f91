"""Detectors that a user gives as SQL.

A statement is one query that reads: it must begin like one, and it is only
ever planned as a subquery, where Spark's grammar takes nothing else.  Tables
come in as parameters of the statement, and so does the window.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snagline.functions.exprs import stamp
from snagline.operators.detectors import KINDS, Span

#: What an id looks like, and how a statement begins.
ID = r"D-\d{2,}"
READS = r"(?i)(?:SELECT|WITH)\b"
_COUNT, _TIME = (T.IntegralType,), (T.StringType, T.TimestampType, T.TimestampNTZType, T.NullType)
#: Columns of each projection with the types that they may have.
CONTRACT = {
    "cluster": {"key": (T.StringType,), "sessions": _COUNT, "events": _COUNT, "first_seen": _TIME, "last_seen": _TIME},
    "session": {"key": (T.StringType,), "session_id": (T.StringType,)},
    "week": {"key": (T.StringType,), "week": (T.StringType,)},
    "weekly": {"key": (T.StringType,), "week": (T.StringType,), "sessions": _COUNT, "events": _COUNT},
}
_PLURAL = {"session": "session-hit", "week": "week-hit", "weekly": "weekly-hit"}


class ContractError(ValueError):
    """A statement whose result is not what its projection has."""


def one_query(sql: str, what: str) -> str:
    """The statement without a closing semicolon, if it is a single query that reads."""
    statement = sql.strip().rstrip(";").strip()
    if not statement:
        raise ValueError(f"{what} is empty")
    if ";" in statement:
        raise ValueError(f"{what} must be one statement")
    if not re.match(READS, statement):
        raise ValueError(f"{what} must be a single SELECT or WITH ... SELECT")
    return statement


@dataclass(frozen=True)
class SqlDetector:
    """A detector whose projections are statements over named tables and the parameters start, end, days."""

    id: str
    version: int
    description: str
    cluster: str
    session: str | None = None
    week: str | None = None
    weekly: str | None = None

    def __post_init__(self):
        if not re.fullmatch(ID, self.id):
            raise ValueError(f"detector id {self.id!r} must look like D-01")
        if self.version < 1:
            raise ValueError(f"versions start at 1, {self.id} has {self.version}")
        if not self.description.strip():
            raise ValueError(f"{self.id} has an empty description")
        for kind in KINDS:
            if getattr(self, kind) is not None:
                one_query(getattr(self, kind), f"{self.id} {_PLURAL.get(kind, kind)} SQL")

    def fingerprint(self, kind: str = "cluster") -> str | None:
        """What the version means: id, version and the statement without its spacing; the description does not count."""
        label = {"cluster": "sql", "session": "hits_sql", "week": "week_sql", "weekly": "weekly_sql"}[kind]
        sql = getattr(self, kind)
        lines = (f"detector={self.id}", f"version={self.version}", f"{label}={' '.join(sql.split())}") if sql is not None else ()
        return hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None

    def planned(self, kind: str, span: Span, **tables: DataFrame) -> DataFrame:
        """The analysed plan of a projection, its columns checked; nothing runs."""
        if kind not in KINDS:
            raise ValueError(f"unknown projection {kind!r}")
        sql = getattr(self, kind)
        if sql is None:
            raise ValueError(f"{self.id} has no {_PLURAL[kind]} SQL")
        spark: SparkSession = next(iter(tables.values())).sparkSession
        statement = one_query(sql, self.id).replace("{", "{{").replace("}", "}}")
        names = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in tables)
        given = {"start": span.start, "end": span.end, "days": span.days}
        args = {k: v for k, v in given.items() if re.search(rf"(?<![\w:]):{k}\b", sql)}
        found = spark.sql(f"WITH {names} SELECT * FROM (\n{statement}\n) AS found", args=args, **tables)
        self._check(kind, found)
        return found

    def _check(self, kind: str, found: DataFrame) -> None:
        want = CONTRACT[kind]
        if sorted(found.columns) != sorted(want):
            raise ContractError(f"{self.id} {kind} gives {', '.join(found.columns)}; it must give {', '.join(want)}")
        for name, types in want.items():
            if not isinstance(found.schema[name].dataType, types):
                raise ContractError(f"{self.id} {kind} gives {name} as {found.schema[name].dataType.simpleString()}")

    def run(self, kind: str, span: Span, **tables: DataFrame) -> DataFrame:
        """A projection like that of the other detectors."""
        found = self.planned(kind, span, **tables)
        time = {c: stamp(c) for c in ("first_seen", "last_seen") if c in found.columns and not isinstance(found.schema[c].dataType, T.StringType)}
        count = {c: F.col(c).cast("long") for c in ("sessions", "events") if c in found.columns}
        return found.withColumns(time | count).select(*CONTRACT[kind])


def catalogue(*detectors: SqlDetector) -> dict[str, SqlDetector]:
    """Detectors by id, in order; an id has one version."""
    found: dict[str, SqlDetector] = {}
    for d in detectors:
        if d.id in found:
            raise ValueError(f"{d.id} is given twice, as versions {found[d.id].version} and {d.version}")
        found[d.id] = d
    return found
