"""strophe: ordered, time-aligned text and signal-feature processing on Spark DataFrames."""
