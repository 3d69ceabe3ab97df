"""postflow: Spark-native operators for posting-style corpora."""
