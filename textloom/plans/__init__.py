"""The index's tables, as plans over plain document tables."""
