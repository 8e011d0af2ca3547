"""Retention analytics on Spark.

DataFrame-to-DataFrame operators for user-retention work: ingest of nested
user records, account and behavioural features, churn labels with leakage
control, data-quality repair, feature statistics and selection, stratified
splits, forest training, evaluation and batch scoring.
"""

from retentio.session import build_session, prepare_session, scratch_path

__all__ = ["build_session", "prepare_session", "scratch_path"]
