"""Training-data operators: sharding, packing, clean-up, matching and export of document tables."""
