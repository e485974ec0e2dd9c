"""Text, event-log and conversation-log jobs on Spark DataFrames and streams."""
