"""plans of the sequence-analytics engine."""
