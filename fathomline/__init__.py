"""A Spark-native engine for the data processing of federated search, page reading and product listing."""
