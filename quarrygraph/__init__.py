"""A PySpark engine for question answering over property graphs of business records."""
