"""Price-catalogue resolution and read models as Spark DataFrame jobs."""
