"""Registered queries: each operator over the given tables, with equivalent SQL where there is one."""
