"""The library's operators run on the driver's tables, and the SQL that checks them."""
