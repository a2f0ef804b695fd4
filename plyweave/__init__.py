"""plyweave: table replication, reconciliation and corpus preparation on PySpark DataFrames."""
