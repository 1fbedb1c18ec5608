"""Derived parcel tables, the registered queries, and the SQL that checks them."""
