"""Spark-native analytics over ensembles of three-dimensional fields and the models that explain them."""
