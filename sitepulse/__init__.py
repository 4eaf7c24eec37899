"""sitepulse: web and behavioural analytics on PySpark."""
