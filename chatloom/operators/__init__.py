"""Operators on DataFrames: state, synchronisation, topics, media, deliveries, nested records."""
