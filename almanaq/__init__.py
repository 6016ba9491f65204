"""Seasonal anomaly and panel analytics on Spark.

Functions take DataFrames and column names and return DataFrames. Sub-packages:

``functions``  column expressions (calendar, text, scalar, Student t)
``sources``    scans, lookups, saved tables
``operators``  aggregation, anomalies, reshaping, panels, regressions, densities, geometry
``plans``      the user-level analyses composed from the operators
"""

import os

# Matrices on the driver are small. A threaded BLAS gains nothing there, and can wait forever when its threads were
# started before the Spark launcher forked.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
