"""netexp: a PySpark-native analytics engine for experiments on networks."""
