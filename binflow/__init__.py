"""binflow: Spark operators for a city network of level-sensing waste containers."""
