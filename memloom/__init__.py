"""memloom: knowledge-graph memory analytics expressed as Spark DataFrame plans."""
