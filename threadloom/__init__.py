"""threadloom: a PySpark-native engine for conversation archives and text corpora."""
