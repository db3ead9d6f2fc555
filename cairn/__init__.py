"""cairn: marketplace analytics and corpus preparation on Spark DataFrames."""
