"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Importing the package itself pulls in no optional
library; each operator lives in its own module.
"""
