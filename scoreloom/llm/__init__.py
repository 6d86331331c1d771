"""Operators for preparing training data: one module for each, all DataFrame in, DataFrame out."""
