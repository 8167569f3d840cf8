"""Folium: document-ledger analytics expressed as Spark DataFrames.

Functions of this package run inside Python workers of executors that may not have the
package installed, so they are pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
