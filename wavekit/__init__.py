"""wavekit: Spark operators for repeated (multi-wave) survey data.

Subpackages: ``sources`` (scans and sinks), ``operators`` (recode, profile, set operations,
ranking, splitting, imputation, models, evaluation, inference, attribution), ``functions``
(column-level helpers: distribution tails, portable hashing), ``plans`` (fixture views,
registered queries and their SQL twins) and ``streaming`` (empty: the workload is batch-only).
"""

__version__ = "0.1.0"
