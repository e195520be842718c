"""Block-structured signals, byte-stream codecs and experiment analytics on PySpark."""
