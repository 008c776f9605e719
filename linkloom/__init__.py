"""linkloom: record linkage and text analytics as lazy Spark plans."""
