"""Analytics over document corpora, topic models and fuzzy control, on Spark DataFrames."""
