"""Query compilers and the registered queries of the core."""
