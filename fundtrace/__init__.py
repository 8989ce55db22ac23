"""Point-in-time fund and manager analytics on Spark DataFrames."""
