"""quillgraph: a PySpark-native engine for personalised ranking over a scholarly graph."""
