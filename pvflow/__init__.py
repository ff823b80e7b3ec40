"""pvflow: DataFrame operators for streams of timestamped process-variable events."""
