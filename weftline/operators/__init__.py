"""DataFrame operators: streams, shards, batches, packing, task views and metrics."""
