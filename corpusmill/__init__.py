"""A PySpark-native engine for text corpora: retrieval, study banks, memory, evaluation and training data."""
