"""Column expressions (all built-in Spark functions, no UDF)."""

from soilcast.functions.season import METEO, SEASONS, season_of
from soilcast.functions.numeric import nan_to_null, safe_div

__all__ = ["METEO", "SEASONS", "season_of", "safe_div", "nan_to_null"]
