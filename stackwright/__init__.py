"""A book-catalogue resolution engine on Spark: extract, normalise, vote,
cleanse, deduplicate, group, sequence and export, as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the functions that run in Python.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
