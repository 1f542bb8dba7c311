"""Octolith: multi-resolution point-cloud analytics expressed as Spark DataFrame plans."""
