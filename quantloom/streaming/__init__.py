"""Beyond the batch operators: rating actions as a stream."""
