"""syllaweave: a PySpark-native analytics engine for structured course documents.

Every operator is a set-at-a-time DataFrame transformation; see README.md.
"""

__version__ = "0.1.0"
