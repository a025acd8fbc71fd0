"""Spark jobs for labelled-audio curation and detector evaluation."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the pickled closure, so a cluster needs no
# separate copy of this package on its Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
