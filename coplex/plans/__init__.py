"""Conditional-distribution plans: tiers, ladders, candidates, rolls."""
