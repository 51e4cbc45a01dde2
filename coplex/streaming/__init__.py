"""Incremental refresh of counts from a stream of incidence rows."""
