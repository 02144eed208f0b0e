"""stratalake: a Spark-native medallion lakehouse, analytics and data-operations engine."""
