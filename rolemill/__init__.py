"""Postings analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors with the query itself, so a
# cluster does not need this package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
