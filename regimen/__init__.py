"""regimen: Spark jobs for drug-combination safety data."""
