"""shelfcast — retail demand forecasting on Spark DataFrames.

Layers:
  sources/    star schema scans, dataset and result sinks
  functions/  column expressions (calendar, z-score, key hash, metrics)
  operators/  DataFrame -> DataFrame steps (sample, grid, stats, encode, models)
  plans/      end-to-end jobs composed from operators (prepare, train, tune, charts)
  streaming/  incremental scoring of arriving sales with a fitted model
"""

from shelfcast.schema import KEY

__all__ = ["KEY"]
