"""setloom: a PySpark-native analytics engine for music-library metadata, mixes and event streams."""
