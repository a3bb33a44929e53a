"""Objects of own classes for every worker, which need not be able to import the package.

A broadcast is pickled by reference; here it is pickled by value first and sent as bytes.
"""

from __future__ import annotations

import sys

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def send(spark: SparkSession, value) -> Broadcast:
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def receive(shared: Broadcast):
    """The object, made anew in each task."""
    return cloudpickle.loads(shared.value)
