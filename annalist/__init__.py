"""annalist: change-history analytics on PySpark."""
