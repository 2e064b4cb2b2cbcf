"""Page-change and deadline analytics as Spark DataFrame plans."""
