"""Training-data operators: token counts, near-duplicates, mixing, chat, toxicity, search, PII, licences, packing.

The Python helpers of these modules travel with the task (pickled by value), so executors
need the public libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
