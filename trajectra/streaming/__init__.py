"""streaming of the sequence-analytics engine."""
