"""Meta-analysis of occurrence records on Spark DataFrames.

A record says, for one study, taxon and place, how many individuals were
examined (``N``) and how many were positive (``NwP``).  The package cleans and
recodes such records, summarises them, works on gridded data and taxonomy trees,
and fits regression models whose data passes run on Spark.
"""
