"""The Boolean query language and its compilation to Spark plans."""
