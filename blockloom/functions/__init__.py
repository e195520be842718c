"""Column functions: one expression each, evaluated in the JVM."""
