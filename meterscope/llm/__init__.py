"""Operators for large training-data pipelines; nothing else in meterscope imports this subpackage."""
