"""Column-expression helpers: everything here builds ``Column`` objects (JVM-side, codegen'd)."""
