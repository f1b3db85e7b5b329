"""stowage: file-tree and archive catalog analytics as Spark plans."""
