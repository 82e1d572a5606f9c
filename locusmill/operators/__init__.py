"""DataFrame operators: interval algebra, ordered scans, counting, bins, nulls and tests."""
