"""Wiring of the operators to the benchmark tables."""
