"""girder: a Spark-native engine for project-risk panels, document evidence and training-data corpora."""
