"""Alpha-research analytics over panels of market bars, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

from .spec import BarSpec

# Executors need no installed copy: the small functions that run in Python tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BarSpec"]
