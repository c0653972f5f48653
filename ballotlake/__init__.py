"""ballotlake: election-collation analytics and training-data preparation on PySpark."""
