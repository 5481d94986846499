"""Entity resolution on Spark: link records of one table to those of two others."""
