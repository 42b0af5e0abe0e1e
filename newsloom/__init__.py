"""newsloom: Spark-native operators for news and event knowledge graphs."""
