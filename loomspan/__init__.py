"""loomspan: a PySpark-native engine for exact sequence, graph, tree and record-matching operators."""
