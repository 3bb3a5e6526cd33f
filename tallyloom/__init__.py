"""tallyloom: document, table, event and vector analytics as Spark queries."""
