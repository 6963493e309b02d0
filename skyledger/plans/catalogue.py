"""Imports every module that registers queries."""

from skyledger.plans import aggregates, modelling, panels, places, preparation, sourced, temporal, weather_reports  # noqa: F401
