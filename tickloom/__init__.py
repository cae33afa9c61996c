"""Market time-series research on Spark: bars, panels, studies, inference, books, cohorts, streams."""
