"""skein: Spark-native analytics over streams of agent-to-agent messages."""
