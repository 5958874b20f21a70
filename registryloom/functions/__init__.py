"""Column builders: each takes Columns and returns a Column, all evaluated inside the JVM."""
