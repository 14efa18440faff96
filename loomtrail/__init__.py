"""loomtrail: process mining over very large event logs, as ordinary Spark DataFrames."""

from loomtrail.model import (
    ColumnBinding,
    EventFilter,
    Retention,
    SemanticContract,
    UnmappedPolicy,
)
from loomtrail.scale import ScalePolicy

__all__ = [
    "ColumnBinding",
    "EventFilter",
    "Retention",
    "ScalePolicy",
    "SemanticContract",
    "UnmappedPolicy",
]
