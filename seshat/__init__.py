"""Session-recall analytics and corpus processing on Spark."""
