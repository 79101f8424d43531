"""tessera: a Spark-first analytics engine (relational SQL, SQLite-flavoured functions, retrieval, versioned tables)."""

__version__ = "0.1.0"
