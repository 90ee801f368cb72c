"""Column -> Column helpers; every one stays inside JVM code generation."""
