"""quernel: a Spark-native relational engine with PostgreSQL query semantics."""
