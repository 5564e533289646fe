"""quern: a PySpark-native query and data-processing engine."""
