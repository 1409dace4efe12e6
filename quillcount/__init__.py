"""quillcount: Spark-native token and text accounting for large corpora."""
