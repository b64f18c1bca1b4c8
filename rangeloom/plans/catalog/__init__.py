"""Registered queries, one module per part of the operator inventory."""

from . import cleaning, evaluation, flows, rasters, sampling, trials  # noqa: F401
