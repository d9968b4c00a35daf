"""Component-identity analytics as lazy Spark plans."""
