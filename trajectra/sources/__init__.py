"""sources of the sequence-analytics engine."""
