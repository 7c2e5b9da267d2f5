"""Spark jobs on vessel positions: from raw pings to trips and fishing activity."""
