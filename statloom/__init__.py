"""Statistics, feature engineering and machine learning as Spark plans."""
