"""Reading and writing the record log."""
