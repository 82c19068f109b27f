"""skarn: Spark-native analytics for document extraction, scoring and auditing."""
