"""A PySpark-native engine that turns feeds, pages and text corpora into clean documents."""
