"""siftlake: retrieval evaluation and corpus analytics expressed as Spark plans."""
