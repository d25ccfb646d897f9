"""Analytics over time-aligned media data as Spark DataFrame plans."""
