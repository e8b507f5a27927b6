"""Column functions: strings in, columns out, all evaluated by the JVM."""
