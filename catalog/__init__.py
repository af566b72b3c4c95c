"""The registered queries and, where SQL can express them, their equivalents."""
