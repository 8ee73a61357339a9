"""Streaming twins of sequence operators, with state for each video."""
