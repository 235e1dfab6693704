"""basketry — shopper analytics expressed as Spark DataFrame / SQL plans.

Layout:
  sources/    table loading, CSV/parquet scans, column-name normalisation
  functions/  Column-level expressions (bins, lookups, flags) and fixed values
  operators/  DataFrame-in / DataFrame-out operators (features, statistics,
              encoders, split, segmentation, CRM, evaluation, models)
  plans/      the registered query catalogue (Spark builder + SQL oracle)
  streaming/  Structured Streaming scoring
"""

__version__ = "0.1.0"
