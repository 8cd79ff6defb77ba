"""orgloom: catalogue analytics on PySpark."""
