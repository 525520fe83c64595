"""skein: a PySpark-native engine for narrative-state analytics."""
