"""turnstone: agent-session analytics as ordinary PySpark DataFrame operators."""
