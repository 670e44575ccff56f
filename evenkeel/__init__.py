"""Rebalancing of binary-labelled tables on Spark: oversampling, undersampling, and nearest neighbours for both."""

import sys

from pyspark import cloudpickle

from evenkeel.errors import BalanceError

# Functions travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BalanceError"]
