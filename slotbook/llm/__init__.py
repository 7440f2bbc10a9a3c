"""Training-data operators: dedup, decontamination, scoring, mixing, extraction.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when it can be imported.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy
# of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
