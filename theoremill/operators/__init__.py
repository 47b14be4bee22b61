"""Operators over DataFrames: graph, trees, data sets, features, search, recommenders, evaluation."""
