"""Make Python task code importable-free on executors.

Functions run inside ``mapInPandas`` / ``applyInPandasWithState`` are pickled
with their module; registering the module by value ships its code with the
task, so executors need no installed copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    try:
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except (KeyError, ValueError):
        pass
