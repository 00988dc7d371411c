"""waygrid: a Spark-native analytics engine for road networks and corpora."""
