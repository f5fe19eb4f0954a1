"""silvan: a Spark-native engine for hierarchical text corpora."""
