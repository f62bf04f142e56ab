"""Reading and writing of tables, stores, logs and configurations."""
