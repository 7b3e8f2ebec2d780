"""Data-quality checks on any DataFrame: declared as objects, run in as few passes as possible.

All row-level and whole-table measures of a suite are one aggregation over the table; each key set of the uniqueness
checks adds one grouping, each reference table one join of distinct values. Nulls: range, pattern and set checks skip them unless
``nulls="fail"``. A check that cannot run has outcome ``error``, and blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.redact import redact_nested
from tablewarden.operators.ledger import running_totals
from tablewarden.operators.membership import possible, with_possible
from tablewarden.session import cut

RESULT = "check string, kind string, outcome string, severity string, blocking boolean, failed_count long, failed_rows long, total_count long, message string"


class BlockingCheckError(Exception):
    """A blocking check of severity error failed; ``failures`` has the result rows."""

    def __init__(self, failures: list):
        super().__init__("; ".join(f"{r['check']}: {r['outcome']}" for r in failures))
        self.failures = failures


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True, kw_only=True)
class Check:
    """What all checks have in common; ``name`` defaults to the kind and the columns."""

    name: str = ""
    severity: str = "error"
    blocking: bool = True

    kind = "check"

    @property
    def title(self) -> str:
        names = getattr(self, "columns", None) or ([self.column] if hasattr(self, "column") else [])
        return self.name or "_".join([self.kind, *names])

    def needs(self) -> list[str]:
        return list(getattr(self, "columns", None) or ([self.column] if hasattr(self, "column") else []))

    def cells(self, df: DataFrame) -> list[Column]:
        """Failure flags of a row, one per cell that the check looks at."""
        return []

    def causes(self) -> list[tuple[str | None, Column]]:
        """For each of ``cells``: the column looked at (None: several) and why it fails, where it does."""
        return [(c, F.lit(f"fails {self.kind}")) for c in self.needs()] or [(None, F.lit(f"fails {self.kind}"))]

    def measures(self, df: DataFrame) -> tuple[Column, Column, Column]:
        """Aggregates (failed_count, failed_rows, passed)."""
        cells = self.cells(df)
        failed = reduce(lambda a, b: a + b, [F.count_if(c) for c in cells])
        rows = F.count_if(reduce(lambda a, b: a | b, cells))
        return failed, rows, failed == 0

    def problem(self, df: DataFrame) -> str | None:
        """Why the check cannot run, if so."""
        missing = [c for c in self.needs() if c not in df.columns]
        return f"no such column: {', '.join(missing)}" if missing else None


@dataclass(frozen=True, kw_only=True)
class NotNull(Check):
    columns: tuple[str, ...]
    kind = "not_null"

    def cells(self, df):
        return [F.col(c).isNull() for c in self.columns]

    def causes(self):
        return [(c, F.lit("null value")) for c in self.columns]


@dataclass(frozen=True, kw_only=True)
class InRange(Check):
    """Inclusive bounds, either may be open; text that is no number fails."""

    column: str
    low: float | None = None
    high: float | None = None
    nulls: str = "skip"
    kind = "in_range"

    def cells(self, df):
        value = F.col(self.column)
        number = value.try_cast("double")
        out = F.lit(False)
        if self.low is not None:
            out = out | (number < self.low)
        if self.high is not None:
            out = out | (number > self.high)
        bad = (value.isNotNull() & number.isNull()) | _flag(out)
        return [bad | value.isNull() if self.nulls == "fail" else bad]

    def causes(self):
        value = F.col(self.column)
        number = value.try_cast("double")
        cause = F.when(value.isNull(), "null value").when(number.isNull(), "not a number")
        if self.low is not None:
            cause = cause.when(number < self.low, f"below {self.low}")
        return [(self.column, cause.otherwise(f"above {self.high}"))]


@dataclass(frozen=True, kw_only=True)
class Matches(Check):
    """Found anywhere in the text; ``anchored`` asks for a match from the start."""

    column: str
    pattern: str
    anchored: bool = False
    nulls: str = "skip"
    kind = "matches"

    def cells(self, df):
        value = F.col(self.column)
        bad = ~value.cast("string").rlike(f"^(?:{self.pattern})" if self.anchored else self.pattern)
        return [_flag(bad) | value.isNull() if self.nulls == "fail" else _flag(bad)]

    def causes(self):
        return [(self.column, F.when(F.col(self.column).isNull(), "null value").otherwise(f"no match of {self.pattern}"))]

    def problem(self, df):
        found = super().problem(df)
        if found is None:
            try:
                df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(self.pattern)
            except Exception:
                return f"bad pattern: {self.pattern}"
        return found


@dataclass(frozen=True, kw_only=True)
class Accepted(Check):
    column: str
    values: tuple
    nulls: str = "skip"
    kind = "accepted_values"

    def cells(self, df):
        value = F.col(self.column)
        bad = ~value.isin(list(self.values))
        return [_flag(bad) | value.isNull() if self.nulls == "fail" else _flag(bad)]

    def causes(self):
        return [(self.column, F.when(F.col(self.column).isNull(), "null value").otherwise("not an accepted value"))]


@dataclass(frozen=True, kw_only=True)
class Custom(Check):
    """A column expression (or SQL text) that is true for good rows; null counts as bad."""

    predicate: Column | str
    kind = "custom"

    def cells(self, df):
        good = F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate
        return [~_flag(good)]

    def causes(self):
        return [(None, F.lit(f"not so: {self.predicate}" if isinstance(self.predicate, str) else "the predicate is not true"))]


@dataclass(frozen=True, kw_only=True)
class RowCount(Check):
    low: int | None = None
    high: int | None = None
    kind = "row_count"

    def measures(self, df):
        n, ok = F.count(F.lit(1)), F.lit(True)
        ok = ok if self.low is None else ok & (n >= self.low)
        return F.lit(0), F.lit(0), ok if self.high is None else ok & (n <= self.high)


@dataclass(frozen=True, kw_only=True)
class Freshness(Check):
    """The newest value is at most ``max_age_s`` seconds before ``as_of``; no value at all fails."""

    column: str
    max_age_s: float
    as_of: str
    kind = "freshness"

    def measures(self, df):
        kind = dict(df.dtypes)[self.column]
        oldest = F.lit(self.as_of).cast(kind) - F.make_dt_interval(secs=F.lit(float(self.max_age_s)))
        ok = _flag(F.max(self.column) >= oldest)
        failed = F.when(ok, 0).otherwise(1)
        return failed, failed, ok


@dataclass(frozen=True, kw_only=True)
class SchemaMatch(Check):
    """Names only; ``failed_count`` is the number of kinds of error (missing, unexpected). Reads no data."""

    columns: tuple[str, ...]
    allow_extra: bool = True
    kind = "schema_match"

    def problem(self, df):
        return None

    def measures(self, df):
        missing, extra = schema_diff(df.columns, self.columns)
        errors = bool(missing) + (bool(extra) and not self.allow_extra)
        return F.lit(int(errors)), F.lit(0), F.lit(errors == 0)


@dataclass(frozen=True, kw_only=True)
class Unique(Check):
    """Rows beyond the first of each key; null is a key like any other."""

    columns: tuple[str, ...]
    kind = "unique"


@dataclass(frozen=True, kw_only=True)
class NoDuplicateRows(Unique):
    """All columns, or some, are not repeated together."""

    columns: tuple[str, ...] = ()
    kind = "no_duplicate_rows"


@dataclass(frozen=True, kw_only=True)
class References(Check):
    """Every value is found in ``ref_column`` of ``reference``."""

    column: str
    reference: DataFrame | None = field(default=None, compare=False)
    ref_column: str = ""
    nulls: str = "skip"
    filtered: bool = False
    kind = "references"

    def problem(self, df):
        if self.reference is None:
            return "no reference table"
        return super().problem(df) or (None if self.ref_column in self.reference.columns else f"no such column: {self.ref_column}")


@dataclass(frozen=True, kw_only=True)
class AcceptedIn(References):
    """Accepted values from a table, for lists too long for a plan. ``accepted_table`` makes one of a Python list."""

    filtered: bool = True
    kind = "accepted_values"


def accepted_table(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """(value) of a long list, sent in Arrow batches, not as part of a plan."""
    return spark.createDataFrame(pa.table({"value": pa.array(values)})).select(F.col("value").cast(kind).alias("value"))


@dataclass(frozen=True, kw_only=True)
class TableCheck(Check):
    """A function of the whole table that gives a boolean or (failed_count, total_count); its exceptions are errors."""

    function: Callable[[DataFrame], Any] = field(compare=False)
    kind = "table"


def schema_diff(actual: list[str], expected: tuple[str, ...] | list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names, in order."""
    return [c for c in expected if c not in actual], [c for c in actual if c not in expected]


def orphans(df: DataFrame, column: str, reference: DataFrame, ref_column: str, nulls: str = "skip") -> DataFrame:
    """Rows without a match in the reference table; nulls are left out, or kept with ``nulls="fail"``. Spark chooses the
    join by size; the reference side is made distinct by the anti join itself."""
    keys = reference.select(F.col(ref_column).alias("_ref")).where(F.col("_ref").isNotNull())
    lost = df.join(keys, df[column] == keys["_ref"], "left_anti")
    return lost if nulls == "fail" else lost.where(F.col(column).isNotNull())


def filtered_orphan_counts(df: DataFrame, column: str, reference: DataFrame, ref_column: str, nulls: str = "skip") -> DataFrame:
    """``orphan_counts`` for a large reference. Values that a filter of the reference's keys rules out are lost at once; the
    others are joined exactly, with those keys only that a filter of these values lets through. So keys that no row has
    are never shuffled, nor are values that are certainly lost."""
    values = cut(df.groupBy(F.col(column).alias("_at")).agg(F.count(F.lit(1)).alias("_n")))
    keys = reference.select(F.col(ref_column).cast(df.schema[column].dataType).alias("_ref")).where(F.col("_ref").isNotNull())
    marked = with_possible(values, [F.col("_at")], keys, ["_ref"], "_maybe").withColumn("_maybe", F.col("_maybe") & F.col("_at").isNotNull())
    maybe = marked.where("_maybe").drop("_maybe")
    asked = possible(keys, [F.col("_ref")], maybe.select("_at"), ["_at"], values.count()).distinct()
    missed = maybe.join(asked, F.col("_at") == F.col("_ref"), "left_anti")
    lost = missed.unionByName(marked.where("NOT _maybe").drop("_maybe"))
    lost = lost if nulls == "fail" else lost.where(F.col("_at").isNotNull())
    bad = lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("bad"))
    return bad.crossJoin(values.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")))  # a row each


def orphan_counts(df: DataFrame, column: str, reference: DataFrame, ref_column: str, nulls: str = "skip") -> DataFrame:
    """One row (bad, n): rows without a match, and all rows. Equal values are counted before they meet the reference, so
    the table is read once and a very common value is one row."""
    values = df.groupBy(F.col(column).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    keys = reference.select(F.col(ref_column).alias("_ref")).where(F.col("_ref").isNotNull()).distinct()
    lost = F.col("_ref").isNull() if nulls == "fail" else F.col("_ref").isNull() & F.col("_at").isNotNull()
    joined = values.join(keys, F.col("_at") == F.col("_ref"), "left")
    return joined.agg(F.coalesce(F.sum(F.when(lost, F.col("_n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def duplicates(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows beyond the first of each key, in ``order``, with their number among the copies, which is counted over range
    partitions: one key may hold most of the rows."""
    return running_totals(df, columns, order, F.lit(1), "copy").where("copy > 1")


def _result(check: Check, outcome: Column, failed: Column, rows: Column, total: Column, message: Column) -> Column:
    return F.struct(
        F.lit(check.title).alias("check"),
        F.lit(check.kind).alias("kind"),
        outcome.alias("outcome"),
        F.lit(check.severity).alias("severity"),
        F.lit(check.blocking).alias("blocking"),
        failed.cast("long").alias("failed_count"),
        rows.cast("long").alias("failed_rows"),
        total.cast("long").alias("total_count"),
        message.cast("string").alias("message"),
    )


def _outcome(ok: Column) -> Column:
    return F.when(ok, F.lit("passed")).otherwise(F.lit("failed"))


def run_suite(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per check (schema ``RESULT``). Lazy, except for table functions, which run their own jobs."""
    spark, none, zero = df.sparkSession, F.lit(None), F.lit(0)
    fused, keyed, parts = [], {}, []
    for check in checks:
        trouble = check.problem(df)
        if trouble is not None:
            parts.append(spark.range(1).select(F.inline(F.array(_result(check, F.lit("error"), zero, zero, zero, F.lit(trouble))))))
        elif isinstance(check, Unique):
            keyed.setdefault(tuple(sorted(check.columns or df.columns)), []).append(check)
        elif isinstance(check, References):
            counted = filtered_orphan_counts if check.filtered else orphan_counts
            counts = counted(df, check.column, check.reference, check.ref_column, check.nulls)
            parts.append(counts.select(F.inline(F.array(_result(check, _outcome(F.col("bad") == 0), F.col("bad"), F.col("bad"), F.col("n"), none)))))
        elif isinstance(check, TableCheck):
            parts.append(_run_table_check(df, check))
        else:
            fused.append(check)
    if fused:
        total, columns = F.count(F.lit(1)), []
        for check in fused:
            failed, rows, ok = check.measures(df)
            columns.append(_result(check, _outcome(ok), failed, rows, total, none))
        parts.append(df.agg(F.array(*columns).alias("r")).select(F.inline("r")))
    for keys, same in keyed.items():
        groups = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
        counts = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), zero).alias("bad"), F.coalesce(F.sum("_n"), zero).alias("n"))
        rows = [_result(c, _outcome(F.col("bad") == 0), F.col("bad"), F.col("bad"), F.col("n"), none) for c in same]
        parts.append(counts.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def _run_table_check(df: DataFrame, check: TableCheck) -> DataFrame:
    spark, zero, none = df.sparkSession, F.lit(0), F.lit(None)
    try:
        value = check.function(df)
        if isinstance(value, bool):
            row = _result(check, F.lit("passed" if value else "failed"), F.lit(int(not value)), zero, zero, none)
        elif isinstance(value, tuple) and len(value) == 2:
            row = _result(check, F.lit("failed" if value[0] else "passed"), F.lit(value[0]), F.lit(value[0]), F.lit(value[1]), none)
        else:
            row = _result(check, F.lit("error"), zero, zero, zero, F.lit(f"unexpected result: {type(value).__name__}"))
    except Exception as error:  # a failing user function is a result of its own
        row = _result(check, F.lit("error"), zero, zero, zero, F.lit(str(error)[:500]))
    return spark.range(1).select(F.inline(F.array(row)))


def blocking_failures(results: DataFrame) -> DataFrame:
    """Blocking, failed or in error, of severity error."""
    return results.where(F.col("blocking") & F.col("outcome").isin("failed", "error") & (F.col("severity") == "error"))


def gate(results: DataFrame) -> DataFrame:
    """One row: whether the table may pass, and how many results block it."""
    return results.agg(F.count_if(F.col("blocking") & F.col("outcome").isin("failed", "error") & (F.col("severity") == "error")).alias("blockers")).select(
        (F.col("blockers") == 0).alias("open"), "blockers"
    )


def validate(df: DataFrame, checks: list[Check]) -> DataFrame:
    """The table itself if no check blocks, else ``BlockingCheckError`` (at most one row per check comes back)."""
    failures = blocking_failures(run_suite(df, checks)).collect()
    if failures:
        raise BlockingCheckError(failures)
    return df


def quarantine(df: DataFrame, checks: list[Check]) -> DataFrame:
    """The rows with ``violations``: the names of the row-level checks that each breaks (empty for good rows)."""
    marks = [F.when(reduce(lambda a, b: a | b, c.cells(df)), F.lit(c.title)) for c in checks if c.cells(df)]
    return df.withColumn("violations", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))


def failed_samples(df: DataFrame, check: Check, order: list[str], n: int = 10) -> DataFrame:
    """Up to ``n`` failing cells in ``order`` (columns that tell rows apart): the row with ``failed_column``, its value as
    text and the reason. Personal data is redacted in the value and in every text of the row."""
    failing = []
    for bad, (column, cause) in zip(check.cells(df), check.causes(), strict=True):
        value = F.lit(None).cast("string") if column is None else F.col(f"`{column}`").cast("string")
        failing.append(F.when(bad, F.struct(F.lit(column).cast("string").alias("failed_column"), value.alias("failed_value"), cause.alias("reason"))))
    rows = df.withColumn("_failed", F.explode(F.array_compact(F.array(*failing))))
    rows = rows.orderBy(*order, "_failed.failed_column").limit(n).select(*df.columns, "_failed.*")
    return redact_nested(rows, columns=[*df.columns, "failed_value"])


def orphan_message(df: DataFrame, column: str, reference: DataFrame, ref_column: str, shown: int = 5) -> DataFrame:
    """One row: the first values without a match, and how many more there are."""
    lost = orphans(df, column, reference, ref_column).select(F.col(column).alias("v")).distinct()
    first = lost.orderBy("v").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("v")).cast("array<string>"), ", ").alias("first"))
    both = first.crossJoin(lost.agg(F.count(F.lit(1)).alias("n")))
    more = F.when(F.col("n") > shown, F.format_string("%s ... (%d more)", "first", F.col("n") - shown)).otherwise(F.col("first"))
    return both.select("n", more.alias("message"))


def reconciles(parent: DataFrame, child: DataFrame, key: str, child_key: str, amount: str, child_amount: Column, tolerance: float = 0.01) -> DataFrame:
    """Parents whose amount differs from the sum of their children by more than the tolerance (no children: sum 0)."""
    sums = child.groupBy(F.col(child_key).alias("_key")).agg(F.sum(child_amount).alias("child_sum"))
    joined = parent.join(sums, parent[key] == sums["_key"], "left").drop("_key")
    joined = joined.withColumn("child_sum", F.coalesce(F.col("child_sum").cast("double"), F.lit(0.0)))
    return joined.where(F.abs(F.col(amount) - F.col("child_sum")) > tolerance)


class Expectation:
    """Fluent form: ``expect(df).column("x").not_null().in_range(low=0).table().row_count(low=1).run()``."""

    def __init__(self, df: DataFrame, severity: str = "error", blocking: bool = True):
        self.df, self.checks, self.names = df, [], ()
        self.common = {"severity": severity, "blocking": blocking}

    def column(self, *names: str) -> Expectation:
        self.names = names
        return self

    def table(self) -> Expectation:
        self.names = ()
        return self

    def _add(self, check: Check) -> Expectation:
        self.checks.append(check)
        return self

    def not_null(self, **kw):
        return self._add(NotNull(columns=self.names, **self.common | kw))

    def unique(self, **kw):
        return self._add(Unique(columns=self.names, **self.common | kw))

    def in_range(self, low=None, high=None, **kw):
        return self._add(InRange(column=self.names[0], low=low, high=high, **self.common | kw))

    def matches(self, pattern: str, **kw):
        return self._add(Matches(column=self.names[0], pattern=pattern, **self.common | kw))

    def accepted(self, *values, **kw):
        return self._add(Accepted(column=self.names[0], values=values, **self.common | kw))

    def fresh(self, max_age_s: float, as_of: str, **kw):
        return self._add(Freshness(column=self.names[0], max_age_s=max_age_s, as_of=as_of, **self.common | kw))

    def references(self, reference: DataFrame, ref_column: str, **kw):
        return self._add(References(column=self.names[0], reference=reference, ref_column=ref_column, **self.common | kw))

    def row_count(self, low=None, high=None, **kw):
        return self._add(RowCount(low=low, high=high, **self.common | kw))

    def no_duplicate_rows(self, **kw):
        return self._add(NoDuplicateRows(columns=self.names, **self.common | kw))

    def schema(self, *columns: str, allow_extra: bool = True, **kw):
        return self._add(SchemaMatch(columns=columns, allow_extra=allow_extra, **self.common | kw))

    def satisfies(self, predicate: Column | str, name: str, **kw):
        return self._add(Custom(predicate=predicate, name=name, **self.common | kw))

    def run(self) -> DataFrame:
        return run_suite(self.df, self.checks)

    def validate(self) -> DataFrame:
        return validate(self.df, self.checks)


def expect(df: DataFrame, **common) -> Expectation:
    return Expectation(df, **common)


KINDS = {c.kind: c for c in (NotNull, Unique, InRange, Matches, Accepted, Custom, RowCount, NoDuplicateRows, Freshness, SchemaMatch, References)}


def suite_from_json(text: str, references: dict[str, DataFrame] | None = None) -> list[Check]:
    """Checks from a JSON list of objects with ``type`` and the fields of that check; ``reference`` is a name."""
    out = []
    for item in json.loads(text):
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in item.items() if k != "type"}
        if item["type"] not in KINDS:
            raise ValueError(f"unknown check type: {item['type']}")
        if "reference" in fields:
            fields["reference"] = (references or {}).get(fields["reference"])
        out.append(KINDS[item["type"]](**fields))
    return out


REGISTERED: dict[str, list[Check]] = {}


def checked(*checks: Check):
    """Decorator of a function that makes a table: ``run_checks(name, df)`` later runs what was declared on it."""

    def mark(function: Callable[..., DataFrame]):
        REGISTERED.setdefault(function.__name__, []).extend(checks)
        return function

    return mark


def run_checks(name: str, df: DataFrame) -> DataFrame:
    return run_suite(df, REGISTERED.get(name, []))


def profile(df: DataFrame, approximate: bool = False, exact_rows: int | None = None) -> DataFrame:
    """One row per column: column, data_type, nulls, nullable, n_distinct, least, greatest (as text), in one pass.

    Exact distinct counts expand rows once per column; ``approximate`` keeps to sketches, and so does a table of more
    than ``exact_rows`` rows, if that is given."""
    approximate = approximate or (exact_rows is not None and df.count() > exact_rows)
    count = F.approx_count_distinct if approximate else F.count_distinct
    kinds = dict(df.dtypes)
    columns = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        nulls = F.count_if(col.isNull())
        columns.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("data_type"),
                nulls.alias("nulls"),
                (nulls > 0).alias("nullable"),
                count(col).alias("n_distinct"),
                F.min(col).cast("string").alias("least"),
                F.max(col).cast("string").alias("greatest"),
            )
        )
    return df.agg(F.array(*columns).alias("r")).select(F.inline("r"))


def checks_table(spark: SparkSession, checks: list[Check]) -> DataFrame:
    """Definitions as a table: check, kind, severity, blocking."""
    rows = [(c.title, c.kind, c.severity, c.blocking) for c in checks]
    return spark.createDataFrame(rows, "check string, kind string, severity string, blocking boolean")
