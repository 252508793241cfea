"""A copy-on-write overlay engine on PySpark: base tables stay read-only, every
write is captured beside them, and every read sees one merged relation."""
