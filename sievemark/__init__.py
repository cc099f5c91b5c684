"""sievemark: a findings engine on DataFrames.

``define_check``, ``define_config``, ``inherit`` and ``run`` are the whole callable surface, with three built-in checks.
"""

from sievemark.plans.definition import define_check, define_config, duplicate_detection, file_metrics, function_metrics, inherit, run

__all__ = ["define_check", "define_config", "duplicate_detection", "file_metrics", "function_metrics", "inherit", "run"]
