"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator behind a general interface; ``queries.py`` registers the thin
``opN_*`` queries over them.
"""

import sys

from pyspark import cloudpickle

# tasks get these functions by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
