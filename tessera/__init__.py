"""tessera: DataFrame operators for music-accompaniment evaluation and corpus preparation on Spark.

The package pickles its functions by value, so Python workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tessera.operators.likelihood import records, values  # noqa: E402
from tessera.operators.matching import METRICS, metric_paths  # noqa: E402
from tessera.operators.stats import describe, five_number, quantiles  # noqa: E402
from tessera.sources.files import child_folders, details, documents, result_items, results  # noqa: E402

__all__ = ["METRICS", "child_folders", "describe", "details", "documents", "five_number", "metric_paths", "quantiles", "records", "result_items", "results", "values"]
