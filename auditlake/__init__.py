"""A PySpark engine for auditable event intelligence."""
