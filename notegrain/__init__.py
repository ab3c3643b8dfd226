"""Analytics over large collections of short, timestamped event sequences, on PySpark."""
