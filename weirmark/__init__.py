"""Network flow analytics and traffic alerting as plain PySpark DataFrame functions."""
