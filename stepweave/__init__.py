"""stepweave: analytics over behaviour-driven step corpora, expressed as Spark DataFrame work."""
