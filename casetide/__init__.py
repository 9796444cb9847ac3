"""casetide: Spark-native spatio-temporal case-control analytics."""
