"""quirefold: a PySpark-native engine for versioned text corpora."""
