"""Rule mining and layout analytics on Spark."""
