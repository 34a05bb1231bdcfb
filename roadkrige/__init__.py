"""roadkrige: a Spark-native engine for road-traffic geostatistics."""
