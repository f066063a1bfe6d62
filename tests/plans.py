"""Looks into the physical plans of frames, those that are stored on the way included."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest

from habitatq.sources import tables


def check_plan(df, python: bool) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if not python:
        assert "ArrowEvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^()]*)", plan):
        assert not re.match(r"\s*(specifiedwindowframe|[\w#]+L? (ASC|DESC))", spec), "window without partition keys"
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"\], \[\], \[", window)


@contextmanager
def stored_plans_checked(python: bool):
    """Within it, every frame written by ``write_table`` has its plan checked first."""
    write = tables.write_table

    def checked(df, *args, **kwargs):
        check_plan(df, python)
        return write(df, *args, **kwargs)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "write_table", checked)
        yield
