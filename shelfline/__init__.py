"""An archive-catalog analytics engine on Spark."""
