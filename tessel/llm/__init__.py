"""Training-data operators: extraction, scans, joins, sharding, packing and mixing over documents."""
