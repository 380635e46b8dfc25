"""functions of the sequence-analytics engine."""
