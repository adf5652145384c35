"""Catalog and table reconciliation on Spark: many submissions against one answer, in one job."""
