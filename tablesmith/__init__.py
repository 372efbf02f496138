"""tablesmith — a Spark-native tabular profiling, preparation and modelling library.

Every operator takes and returns DataFrames.  Fitted operators come as pairs
``fit_*(train, ...) -> params DataFrame`` and ``apply_*(df, params) -> DataFrame`` so that
fitting on the training split only, and reuse on new data, hold by construction.
"""

__version__ = "0.1.0"
