"""Operators that prepare text and vectors for training models: scoring, search, de-duplication,
scanning, extraction, mixing and tokenisation. Each module holds one operator; ``queries`` registers
a thin query for each."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run in tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
