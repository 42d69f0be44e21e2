"""DataFrame operators for daily market bars, news and direction models on Spark."""
