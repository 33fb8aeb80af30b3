"""Grids to observations: tall cells and checks are written once, as the plan reads them a dozen times."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridmill.operators import checks, coding, tables
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options
from gridmill.shared import cut


@dataclass(frozen=True)
class Observed:
    """What the plan gives; cells and checks are tables in the shared folder, long is lazy."""

    framed: DataFrame
    cells: DataFrame
    checks: DataFrame
    long: DataFrame


def observe(grids: DataFrame, context: DataFrame, vocabulary: DataFrame, key: Sequence[str] = KEY, fuzzy: bool = True, options: Options = DEFAULT) -> Observed:
    """Frames, tall cells, checks and long observations of all tables.

    `context` has the key and title, unit, subject, period, source of each table.
    """
    framed = cut(tables.frames(grids, key, options), "frames")
    cells = cut(tables.tall(framed, key), "cells")
    found = cut(checks.run_checks(framed, cells, key, options), "checks")
    return Observed(framed, cells, found, coding.to_long(cells, found, context, vocabulary, key, fuzzy, options))
