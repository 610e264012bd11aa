"""tessera: a Spark-native engine for ranked retrieval and structural analytics over indexed code and documents."""
