"""Play-log analytics and entity resolution as Spark DataFrame transformations."""
