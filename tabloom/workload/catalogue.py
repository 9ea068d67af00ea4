"""Imports every workload module so that its queries are registered."""

from tabloom.workload import charts, context, drift, eda, features, laws, lifecycle, metrics, profile, recipe, sources, supervised, unsupervised  # noqa: F401
from tabloom.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
