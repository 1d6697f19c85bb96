"""SQL used only to check the Spark results."""
