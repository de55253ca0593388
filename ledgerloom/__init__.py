"""ledgerloom: project cost analytics as Spark DataFrame plans."""
