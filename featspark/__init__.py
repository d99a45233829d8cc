"""featspark: feature engineering, profiling and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what a task refers to travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .functions.exprs import signed_log1p  # noqa: E402
from .operators.encoding import EncodingFeatures  # noqa: E402
from .operators.numeric import NumericFeatures  # noqa: E402
from .operators.plotters import ClassifierPlotter, EDAPlotter, ModelPlotter, RegressionPlotter, TimeSeriesPlotter  # noqa: E402
from .operators.summary import summarize  # noqa: E402
from .operators.timeseries import TimeseriesFeatures  # noqa: E402

__all__ = ["ClassifierPlotter", "EDAPlotter", "EncodingFeatures", "ModelPlotter", "NumericFeatures", "RegressionPlotter", "TimeSeriesPlotter",
           "TimeseriesFeatures", "signed_log1p", "summarize"]
