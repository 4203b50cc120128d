"""Web-capture analytics on Spark: capture listings in, one current file per address out."""
