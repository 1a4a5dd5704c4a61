"""retentio: customer-retention analytics as Spark DataFrame jobs.

Layout
------
``sources``    readers/writers: base tables, the ``customer_360`` mart, files,
               model artifacts, the synthetic generator.
``functions``  column expressions (parsing, right-closed bins, stable hashes)
               and small vectorised numeric helpers used inside pandas UDFs.
``operators``  table-level analytics: cleaning, profiling, binning,
               chi-square, decision (profit curve, scoring, A/B/C), imputation,
               ML (pipelines, tuning, ensembles, k-NN), explanations.
``plans``      composite jobs (EDA report, train/deploy, threshold + score +
               assign) and the registry used by ``__spark_entry__``.
``streaming``  Structured Streaming scorer.
"""

__version__ = "0.1.0"
