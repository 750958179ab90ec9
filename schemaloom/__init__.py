"""PySpark-native analytics for event-schema induction over large text corpora."""
