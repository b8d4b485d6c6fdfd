"""Functions that run inside tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Functions of the module travel inside the tasks, so workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
