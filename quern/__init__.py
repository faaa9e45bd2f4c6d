"""A PySpark engine for labelled text corpora and the systems that score them."""

from __future__ import annotations

import sys


def ship_by_value() -> None:
    """Let functions of this package reach Python workers that can't import it."""
    from pyspark import cloudpickle

    if __name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
