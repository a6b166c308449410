"""A PySpark-native engine for corpus preparation and behaviour audits."""
