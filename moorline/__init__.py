"""moorline: a Spark-native engine for aligning mentions with a knowledge base."""
