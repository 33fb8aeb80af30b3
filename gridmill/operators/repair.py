"""Row repair: rows of a table that fails checks are taken from another reader's table where that helps.

Rows are tried in order, and what was taken counts for the rows after it, so a table is repaired by
one kernel call. The kernel gets numbers that Spark has parsed and keeps a ledger of failed checks:
a trial updates what its row touches (its own checks, the sums of its columns, the products of its
group) and counts nothing else anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import numbers as N
from gridmill.functions.text import JOIN
from gridmill.operators import checks as C
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options

#: Decimals to which sums are exact, as in the checks on cells.
TICKS = 10_000

OK, MISSING, ERROR = "ok", "missing", "error"


def _python(pattern: str) -> re.Pattern:
    """A pattern of the checks for Python's engine; what its flags ask for is the default there but for letter case."""
    flags = re.IGNORECASE if pattern.startswith("(?iU)") else 0
    return re.compile(re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), pattern.removeprefix("(?iU)")), flags)


def _marks(pattern: str, names: Sequence[str]) -> np.ndarray:
    found = _python(pattern)
    return np.array([bool(found.search(n)) for n in names], bool)


def _ticks(values: np.ndarray) -> list[int]:
    return [0 if np.isnan(v) else round(v * TICKS) for v in values.tolist()]


class Ledger:
    """Failed checks of one table, as run_checks counts them, kept up to date row by row."""

    def __init__(self, names: Sequence[str], labels: Sequence[str], values: np.ndarray, errors: np.ndarray, options: Options = DEFAULT) -> None:
        self.options, self.values, self.errors = options, values.copy(), errors.copy()
        self.row_total, self.col_total = _marks(C.total_word(options), labels), _marks(C.total_word(options), names)
        self.row_rate, self.col_rate = _marks(C.RATE, labels), _marks(C.RATE, names)
        unnamed, glued = _marks(C.PLACEHOLDER, names), _marks(C.GLUED_VALUE, names)
        self.header = int(len(names) > 0 and (unnamed.all() or glued.any()))
        self.sums_rows = self.row_total.any() and len(labels) >= 3
        self.sums_cols = self.col_total.any() and len(names) >= 3
        kinds = (C.AREA, C.YIELD, C.PRODUCTION)
        self.across = _places(kinds, names)
        self.groups: list[tuple[set[int], list[int]]] = []
        if self.across is None:
            outer: dict[str, list[int]] = {}
            for i, label in enumerate(labels):
                outer.setdefault(label.split(JOIN)[0] if JOIN in label else "", []).append(i)
            for rows in outer.values():
                if (at := _places(kinds, [labels[i] for i in rows])) is not None:
                    self.groups.append((set(rows), [rows[k] for k in at]))
        parts = ~self.row_total
        self.sums = [sum(col) for col in zip(*(_ticks(r) for r in self.values[parts]))] or [0] * len(names)
        self.counts = (~np.isnan(self.values[parts])).sum(0)
        self.beyond = (np.abs(self.values) > options.upper_bound).sum(0)
        self.own = [self._row(i, self.values[i], self.errors[i]) for i in range(len(labels))]
        self.down = [self._group(at, self.values) for _, at in self.groups]
        self.failures = self._all(self.own, self.sums, self.counts, self.beyond, self.values, self.down)

    def _far(self, actual: float, ticks: int) -> bool:
        expected = ticks / TICKS
        gap = abs(actual - expected)
        return gap / max(abs(expected), 1.0) > self.options.sum_tolerance and gap > self.options.absolute_tolerance

    def _wrong(self, area: float, per_area: float, made: float) -> bool:
        if np.isnan([area, per_area, made]).any() or made == 0:
            return False
        gap = abs(made - area * per_area / 1000)
        return gap / abs(made) > self.options.product_tolerance and gap > self.options.absolute_tolerance

    def _row(self, i: int, values: np.ndarray, errors: np.ndarray) -> int:
        """Failures that only this row decides: unreadable cells, its total columns, its product."""
        bad = int(errors.sum())
        if self.sums_cols:
            parts = values[~self.col_total]
            if (~np.isnan(parts)).sum() >= 2 and not self.row_rate[i]:
                ticks = sum(_ticks(parts))
                bad += sum(self._far(values[j], ticks) for j in np.flatnonzero(self.col_total & ~self.col_rate & ~np.isnan(values)))
        if self.across is not None:
            bad += self._wrong(*values[self.across])
        return bad

    def _group(self, at: list[int], values: np.ndarray) -> int:
        return sum(self._wrong(*values[at, j]) for j in range(values.shape[1]))

    def _all(self, own: list[int], sums: list[int], counts: np.ndarray, beyond: np.ndarray, values: np.ndarray, down: list[int]) -> int:
        bad = self.header + sum(own) + int((beyond > 0).sum()) + sum(down)
        if self.sums_rows:
            for j in np.flatnonzero((counts >= 2) & ~self.col_rate):
                if sums[j]:
                    bad += sum(self._far(values[t, j], sums[j]) for t in np.flatnonzero(self.row_total & ~self.row_rate) if not np.isnan(values[t, j]))
        return bad

    def with_row(self, i: int, values: np.ndarray, errors: np.ndarray) -> Ledger:
        """The ledger with another row i; this one stays."""
        new = object.__new__(Ledger)
        new.__dict__.update(self.__dict__)
        new.values, new.errors, new.own = self.values.copy(), self.errors.copy(), list(self.own)
        new.values[i], new.errors[i] = values, errors
        new.own[i] = new._row(i, values, errors)
        old = self.values[i]
        new.beyond = self.beyond - (np.abs(old) > self.options.upper_bound) + (np.abs(values) > self.options.upper_bound)
        if not self.row_total[i]:
            new.sums = [s - a + b for s, a, b in zip(self.sums, _ticks(old), _ticks(values))]
            new.counts = self.counts - ~np.isnan(old) + ~np.isnan(values)
        new.down = [new._group(at, new.values) if i in rows else n for (rows, at), n in zip(self.groups, self.down)]
        new.failures = new._all(new.own, new.sums, new.counts, new.beyond, new.values, new.down)
        return new


def _places(kinds: Sequence[str], names: Sequence[str]) -> list[int] | None:
    """The first place of each kind among names; none unless all have one."""
    found = [np.flatnonzero(_marks(k, names)) for k in kinds]
    return [int(f[0]) for f in found] if all(len(f) for f in found) else None


class Rows:
    """Cells of one table beside their numbers."""

    def __init__(self, stage: str, names: Sequence[str], labels: Sequence[str], body: Sequence[Sequence[str]], parsed: Sequence[Sequence[dict]]) -> None:
        self.stage, self.names, self.labels, self.body = stage, list(names), list(labels), [list(r) for r in body]
        shape = (len(self.labels), len(self.names))
        self.values = np.array([[np.nan if c["value"] is None else c["value"] for c in r] for r in parsed], float).reshape(shape)
        status = np.array([[c["status"] for c in r] for r in parsed], object).reshape(shape)
        self.errors, self.missing = status == ERROR, status == MISSING
        self.at: dict[str, int] = {}
        for i, label in enumerate(self.labels):
            self.at.setdefault(label, i)


def helps(mine: Rows, i: int, donor: Rows, k: int) -> bool:
    """Whether a donor's row may stand for a row: readable throughout, equal where both have numbers, and it mends or fills something."""
    a, b = mine.values[i], donor.values[k]
    if donor.errors[k].any() or ((a != b) & ~np.isnan(a) & ~np.isnan(b)).any():
        return False
    return bool(mine.errors[i].any() or (mine.missing[i] & ~np.isnan(b)).any())


def mend(table: Rows, donors: Sequence[Rows], options: Options = DEFAULT) -> list[str]:
    """Swaps donors' rows into the table; the stage that each row comes from.

    A row is taken if the table then fails fewer checks; one that was readable may leave the number
    as it was. Nothing is tried in a table without failures.
    """
    sources = [table.stage] * len(table.labels)
    ledger = Ledger(table.names, table.labels, table.values, table.errors, options)
    fitting = [d for d in donors if d.names == table.names]
    for i, label in enumerate(table.labels if ledger.failures and fitting else ()):
        readable = not table.errors[i].any()
        for donor in fitting:
            k = donor.at.get(label)
            if k is None or not helps(table, i, donor, k):
                continue
            trial = ledger.with_row(i, donor.values[k], donor.errors[k])
            if trial.failures < ledger.failures + readable:
                ledger, sources[i] = trial, donor.stage
                table.body[i] = list(donor.body[k])
                break
    return sources


def _parsed(body: Column) -> Column:
    return F.transform(body, lambda r: F.transform(r, N.parsed))


def repair(framed: DataFrame, given: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """framed tables with donors' rows swapped in, and sources (the stage of each row).

    `given` has the key of the table to repair and donors: array<struct<stage, names, labels, body>>,
    in order; a table without any stays as it is. A table is one row, so the kernel sees single
    tables, batch by batch, and nothing is grouped. Frames should come from a table (`cut`): their
    expressions are too large to be copied into this plan.
    """
    both = framed.join(given.select(*key, "donors"), list(key), "left")

    none = F.array().cast("array<struct<stage:string,names:array<string>,labels:array<string>,body:array<array<string>>>>")
    donors = F.transform(F.coalesce("donors", none), lambda d: F.struct(d["stage"].alias("stage"), d["names"].alias("names"), d["labels"].alias("labels"), d["body"].alias("body"), _parsed(d["body"]).alias("parsed")))
    schema = T.StructType([*framed.schema.fields, T.StructField("sources", T.ArrayType(T.StringType()))])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.to_dict("records"):
                mine = Rows(t["stage"], t["names"], t["labels"], t["body"], t["gm_parsed"])
                sources = mend(mine, [Rows(d["stage"], d["names"], d["labels"], d["body"], d["parsed"]) for d in t["gm_donors"]], options)
                out.append((mine.body, sources))
            yield batch.drop(columns=["gm_parsed", "gm_donors"]).assign(body=[b for b, _ in out], sources=[s for _, s in out])

    return both.select(*framed.columns, _parsed(F.col("body")).alias("gm_parsed"), donors.alias("gm_donors")).mapInPandas(kernel, schema)
