"""A Spark-native engine for knowledge stores, code structure and session telemetry."""
