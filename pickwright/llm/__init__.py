"""Training-data operators. Nothing else in the library imports this subpackage.

Functions that run in Python workers are pickled by value, so executors need
numpy, pyarrow and the tokenizer files, but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
