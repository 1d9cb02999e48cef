"""Selection analytics for multi-sensor recordings, Spark first."""
