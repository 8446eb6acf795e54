"""shardwright: the data side of language-model pre-training as Spark jobs.

Documents become token streams and fixed-size shards; shards become shifted
training windows, leakage-safe splits, seeded epoch orders and resumable batch
plans; artifacts are audited against their manifests; telemetry, evaluation and
candidate-score tables are analysed with DataFrame operators.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python tasks (Arrow encoders, grouped and stateful
# functions) are shipped by value, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from shardwright.session import checkpoint_dir, get_spark  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
