"""Analytics over captured web-crawl data as PySpark DataFrame operators."""
