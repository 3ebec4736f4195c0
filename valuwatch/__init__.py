"""Control-gap and valuation-surveillance analytics on PySpark DataFrames."""
