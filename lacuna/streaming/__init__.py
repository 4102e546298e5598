"""Target sets arriving as a stream (readStream + foreachBatch) against precomputed families."""
