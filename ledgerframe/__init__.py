"""ledgerframe: bank-ledger reconciliation and serving as Spark DataFrame operators.

Functions that run on executors travel by value, so executors need no copy of
the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
