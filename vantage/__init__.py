"""Scenario discovery on Spark: designs, evaluation tables, case rules and box search."""
