"""Millrace: a library of composable PySpark DataFrame transforms."""
