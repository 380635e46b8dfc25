"""operators of the sequence-analytics engine."""
