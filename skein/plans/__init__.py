"""Registered queries."""

from skein.plans import catalogue, derived, stateful  # noqa: F401  each adds its queries to the catalogue
