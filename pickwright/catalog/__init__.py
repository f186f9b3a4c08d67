"""Every operator bound to the test tables, with the SQL it must agree with."""

from __future__ import annotations

from pickwright.catalog.base import CASES


def load() -> dict:
    from pickwright.catalog import aggs, contest, history, joins, models, pipelines, rows, scalars, sets, sources, windows  # noqa: F401

    return CASES
