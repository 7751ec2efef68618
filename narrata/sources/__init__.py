"""Readers, sinks and the mapping of stored tables to canonical tables."""
