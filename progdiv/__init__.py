"""progdiv: a PySpark-native engine for measuring generated programs and texts."""
