"""Column factories: everything here stays inside JVM expressions."""
