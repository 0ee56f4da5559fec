"""Sports time-series analytics on Spark: feeds, features, ratings, prices, evaluation."""
