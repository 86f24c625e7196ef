"""vouch: table contracts and dataset readiness as Spark jobs.

Declare checks on tables, rows, columns and schemas; run them as Spark
plans (one scan per table); get back a results DataFrame with status,
points, dependency skips and suite scores.  Also: distributed table and
schema comparison, manifest diff and repair, per-user namespace derivation
and fan-out, and stream progress tracking.
"""

from vouch.plans.suite import Suite  # noqa: F401
from vouch.operators.checks import register_check  # noqa: F401
