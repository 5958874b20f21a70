"""Reading and writing tables, and the headers the source files carry."""
