"""Images and other collections of vectors as tables: patches, kernel regression, pyramids, schedules and samplers on Spark."""
