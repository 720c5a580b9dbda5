"""Layout forensics as Spark plans: positioned text cells, baselines, blocks, pairs, matches and outliers."""
