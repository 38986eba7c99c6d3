"""featurelens: two-table feature-quality and agreement analytics on Spark.

Given two wide tables of numeric features (and optionally a key pairing their
rows) every report is a lazy DataFrame computed for all shared features at
once: profiles, distributions, plausibility, outliers, correlation,
redundancy, two-sample comparison, record-level agreement and a quality
score.  See ``featurelens.pipeline.run``.
"""

from .spec import COMPARISON, VALIDATION, RunSpec, Thresholds  # noqa: F401
