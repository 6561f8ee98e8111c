"""tessera: retrieval, knowledge-graph and text-processing operators declared as Spark plans."""
