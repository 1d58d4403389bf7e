"""Reading observation tables and writing results."""

from soilcast.sources.observations import (
    LINEITEM_SCHEMA,
    load_observations,
    plant_observations,
    read_checked,
    observations,
)
from soilcast.sources.sinks import write_results

__all__ = [
    "LINEITEM_SCHEMA",
    "load_observations",
    "plant_observations",
    "read_checked",
    "observations",
    "write_results",
]
