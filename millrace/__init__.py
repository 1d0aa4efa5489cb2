"""millrace: entity-timeline analytics and data cleaning on PySpark."""
