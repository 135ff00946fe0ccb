"""Views, named queries and the SQL they are held against."""
