"""Scalar functions: facet rules and normalisation."""
