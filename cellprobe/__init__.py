"""cellprobe: type profiling, migration and verification of loosely typed tables on Spark."""
