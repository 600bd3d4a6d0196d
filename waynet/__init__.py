"""waynet: network, location and corpus analytics as Spark jobs.

Python helpers that run inside tasks are pickled by value, so executors need
no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
