"""Operators of a training-data pipeline: tokenising, token files, filters, de-duplication,
mixing, classifiers. Nothing else in the library imports this subpackage."""
