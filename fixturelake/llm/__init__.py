"""Training-data operators: filtering, deduplication, counting, mixing and sharding of documents."""
