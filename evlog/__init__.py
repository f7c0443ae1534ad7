"""An append-only event log and analytics engine on PySpark."""
