"""spanloom: span-annotation analytics declared as Spark plans."""
