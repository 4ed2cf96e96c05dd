"""A Spark-native engine for namespaces of documents: pattern search, ranking, graphs, versions."""
