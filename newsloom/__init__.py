"""newsloom: a Spark-native engine for source-aware news corpora."""
