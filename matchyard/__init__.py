"""Record reconciliation on Spark: text to records, matching, comparison, checks and reports."""
