"""Training-data operators: filters, counts, shards, quality, deduplication, archives, mixes, scans."""
