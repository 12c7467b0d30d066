"""Column functions; all of them run inside the JVM unless their docstring says otherwise."""
