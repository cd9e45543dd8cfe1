"""Registered queries: stand-ins for a workspace made of the corpus tables, and plans over them."""
