"""chatlens: monthly chat-assistant usage analytics as Spark DataFrame plans.

Packages:
  sources    export ingest (JSON), the conversations bridge, landing table I/O
  functions  column expressions: time, text, keyword rules, quality, KPI
  operators  period filter, enrichment, aggregates, distributions, joins, views, clustering
  plans      the department report / analysis, query registry, oracle SQL
  streaming  incremental landing of export files
"""

__version__ = "0.1.0"

from .functions.rules import RuleSet  # noqa: E402
from .operators.cluster import cluster_prompts  # noqa: E402
from .operators.override import load_department_map, read_department_map  # noqa: E402
from .plans.report import Analysis  # noqa: E402
from .sinks import write_report, write_table  # noqa: E402
from .sources.exports import flatten_exports, land_messages, read_exports, read_landed  # noqa: E402

__all__ = ["Analysis", "RuleSet", "cluster_prompts", "flatten_exports", "land_messages", "load_department_map",
           "read_department_map", "read_exports", "read_landed", "write_report", "write_table"]
