"""Predicates, samples and counts over baskets."""
