"""Results as documents: hits, statuses and reports."""
