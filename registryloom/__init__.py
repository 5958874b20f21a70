"""Cleaning, joining, tagging and filtering of clinical-trial registry extracts on Spark."""

from registryloom.names import DISPLAY, Names

__all__ = ["DISPLAY", "Names"]
