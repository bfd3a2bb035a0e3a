"""Import-document analytics over tables of many shipments, on Spark DataFrames."""
