"""kindling: Spark-native preparation, scoring and evaluation of binary risk classifiers.

Every public operator is a function from DataFrame(s) to a DataFrame. Nothing
collects data rows to the driver; only parameter-sized results (scaler means,
weight matrices, one threshold per model) are ever brought back.
"""

from kindling.session import build_session, cut_lineage, drop_scratch_tables, ensure_checkpoint_dir

__all__ = ["build_session", "cut_lineage", "drop_scratch_tables", "ensure_checkpoint_dir"]
