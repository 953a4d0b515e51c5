"""Text moderation and stream policy on Spark DataFrames."""
