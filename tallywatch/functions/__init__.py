"""SQL expression texts shared by the operators."""
