"""factloom: a Spark-native engine for versioned dependency facts."""
