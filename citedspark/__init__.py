"""Member-centred analytics on Spark in which every figure cites its source rows."""
