"""Operators: EDA aggregates, missing-data treatments, features, models, stacking, scoring."""
