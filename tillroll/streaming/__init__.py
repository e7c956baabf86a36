"""Row-wise cleaning of raw extracts as they arrive."""
