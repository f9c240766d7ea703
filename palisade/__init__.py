"""A PySpark analytics engine for ordered per-key signals, evidence fusion and report audits."""
