"""Training-data pipeline operators: deduplication, filtering, decontamination, tokenisation, scans.

Nothing outside this subpackage imports it.  Functions, and models in broadcasts, are shipped to executors by
value, so executors need only numpy, pyarrow, xxhash and the tokenizer libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
