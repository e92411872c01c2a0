"""Analytics over stored-procedure estates and training corpora, written as Spark jobs."""
