"""tidemark: a PySpark engine for monitoring information integrity in social-media data."""
