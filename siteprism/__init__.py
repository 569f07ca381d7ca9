"""siteprism: a Spark-native engine for discovering, extracting, scoring and querying business websites."""
