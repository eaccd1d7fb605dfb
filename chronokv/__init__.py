"""A Spark-native analytics engine for versioned key-value data, replicated logs and corpora."""
