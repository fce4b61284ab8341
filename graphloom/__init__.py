"""graphloom: a Spark-native engine for entity-annotated text and knowledge graphs."""
