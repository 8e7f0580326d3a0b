"""A PySpark engine for code and document intelligence."""
