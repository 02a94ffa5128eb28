"""Operators: DataFrame in, DataFrame out, with an explicit as_of."""
