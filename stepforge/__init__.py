"""stepforge: a PySpark engine for building and auditing step-level datasets."""
