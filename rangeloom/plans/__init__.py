"""Whole flows, derived input views and the registered queries."""
