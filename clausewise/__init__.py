"""A logic-program query engine whose plans are ordinary Spark DataFrames."""
