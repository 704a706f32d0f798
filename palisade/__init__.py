"""Text moderation and training-data preparation on Spark DataFrames."""
