"""Reading and writing tables, run rows and the audit log."""
