"""A tick-data and time-series analytics engine on PySpark."""
