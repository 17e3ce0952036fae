"""gradelake: PySpark operators for large collections of scanned, graded exam answer books."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code with them, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
