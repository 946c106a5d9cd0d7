"""A Spark-native engine for corpus analytics: documents in, searchable and traceable tables out."""
