"""folioquery: a PySpark-native engine for collections of personal documents and records."""
