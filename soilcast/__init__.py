"""soilcast: season-wise ground-temperature modelling as Spark DataFrame and ``pyspark.ml`` jobs.

Layout
------
``sources``    reading observation tables (with schema checks) and writing results
``functions``  column expressions: seasons, missing markers, safe ratios
``operators``  EDA aggregates, missing-data treatments, features, models, stacking, scoring
``plans``      end-to-end flows and the registered queries with their SQL oracles
``streaming``  intentionally empty: the modelled work is batch only
"""

__version__ = "0.1.0"
