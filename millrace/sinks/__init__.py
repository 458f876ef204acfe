"""Writers of files, partitioned datasets and catalog tables."""
