"""Operators for preparing training data: jobs over documents and embeddings.

Python workers import this package by name where PYTHONPATH holds it. Elsewhere its
functions travel to them by value.
"""

import os
import sys

from pyspark import cloudpickle

_root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _root not in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
