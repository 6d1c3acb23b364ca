"""Change-data-capture and event-log pipelines on Spark DataFrames."""
