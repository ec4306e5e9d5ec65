"""frameloom: Spark jobs over media files, pixel tables and file catalogs."""
