"""plumbline: a canonical data engine on PySpark."""
