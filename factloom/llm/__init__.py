"""Operators for training-data pipelines. Nothing else in factloom imports this subpackage."""
