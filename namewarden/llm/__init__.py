"""Operators for large training-data corpora.

The functions that run on executors are pickled by value, so a cluster needs
no copy of this package; ``common.process_cache`` keeps loaded vocabularies
alive between the tasks of one Python worker.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
